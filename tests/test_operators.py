"""Operators beyond what the catalog shows: registry, dictionary lifecycle, policy and gates on edge cases."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import checks, codes, normalize, scan
from maskwright.functions import forms as plain
from maskwright.functions import spans as S
from maskwright.operators import analytics, dictionary, engine, gate, names, policy, registry, requests, training
from maskwright.sources import journals

KEY = b"0123456789abcdef0123456789abcdef"


def test_collisions_resolve_by_arrival(spark):
    rows = [("P", f"v{i}", i) for i in range(60)]
    values = spark.createDataFrame(rows, "cls string, identity string, first_seen int")
    got = registry.assign(values, KEY, length=2, salts=64).collect()
    assert len(got) == 60 and len({r.token for r in got}) == 60
    by_first = {}
    for _, v, i in rows:
        code = spark.range(1).select(codes.code(F.lit("P"), F.lit(v), KEY, 0, 2)).first()[0]
        by_first.setdefault(code, v)
    assert {r.token: r.identity for r in got if r.salt == 0} == by_first


def test_registered_identities_keep_their_code(spark):
    first = registry.assign(spark.createDataFrame([("P", "a", 5)], "cls string, identity string, first_seen int"), KEY, length=1, salts=640)
    held = first.select("token", "identity")
    more = registry.assign(spark.createDataFrame([("P", x, i) for i, x in enumerate("xyza")], "cls string, identity string, first_seen int"), KEY, held, length=1, salts=640)
    got = {r.identity: r.token for r in more.collect()}
    assert got["a"] == first.first().token and len(set(got.values())) == 4


def test_running_out_of_codes_is_an_error(spark):
    values = spark.createDataFrame([("P", f"v{i}", i) for i in range(40)], "cls string, identity string, first_seen int")
    with pytest.raises(RuntimeError):
        registry.assign(values, KEY, length=1, salts=2)


def test_first_choices_need_no_code_for_the_rest(spark):
    """More identities than codes: each code is the first seen's that wants it."""
    values = spark.createDataFrame([("P", f"v{i}", i) for i in range(200)], "cls string, identity string, first_seen int")
    want = values.withColumn("token", codes.code(F.lit("P"), F.col("identity"), KEY, 0, 1)).groupBy("token").agg(F.min_by("identity", "first_seen").alias("identity"))
    got = {r.token: r.identity for r in registry.first_choices(values, KEY, length=1).collect()}
    assert got == {r.token: r.identity for r in want.collect()}


def test_codes_grow_where_their_space_runs_short(spark):
    """More identities than codes of one letter and of two, in one of two classes."""
    values = spark.createDataFrame([(c, f"v{i}", i) for c, n in (("P", 1500), ("T", 5)) for i in range(n)], "cls string, identity string, first_seen int")
    got = registry.assign(values, KEY, length=1, salts=640, longest=8).collect()
    firsts = values.select(codes.code(F.col("cls"), F.col("identity"), KEY, 0, 1)).distinct().count()
    assert len(got) == len({r.token for r in got}) == 1505 and sum(r.salt == 0 for r in got) == firsts
    assert {len(r.token) for r in got if r.cls == "T"} == {3} and max(r.salt for r in got) < 30


def test_a_code_of_several_holders_is_taken(spark):
    code = spark.range(1).select(codes.code(F.lit("P"), F.lit("a"), KEY, 0, 1)).first()[0]
    held = spark.createDataFrame([(code, "a"), (code, "b")], "token string, identity string")
    values = spark.createDataFrame([("P", "a", 1)], "cls string, identity string, first_seen int")
    got = registry.assign(values, KEY, held, length=1, salts=640).collect()
    assert len(got) == 1 and got[0].token != code


def test_upsert_never_makes_one_person_of_two(spark):
    row = "token string, cls string, value string, identity string, forms array<string>, created_at int, last_used_at int, source string"
    old = spark.createDataFrame([("t", "P", "A", "a", ["A"], 1, 1, None), ("u", "P", None, None, [], 1, 1, None)], row)
    new = spark.createDataFrame([("t", "P", "B", "b", ["B"], 2, 2, None), ("u", "P", "C", "c", ["C"], 2, 2, None)], row)
    got = sorted((r.token, r.identity, r.value, r.forms) for r in registry.upsert(old, new).collect())
    assert got == [("t", "a", "A", ["A"]), ("t", "b", "B", ["B"]), ("u", "c", "C", ["C"])]


def test_forms_are_capped_in_order(spark):
    row = spark.range(1).select(registry.merged_forms(F.array(*(F.lit(str(i)) for i in range(6))), F.array(F.lit(" 3 "), F.lit(""), *(F.lit(str(i)) for i in range(6, 12)))).alias("f")).first()
    assert row.f == [str(i) for i in range(8)]


def test_beyond_the_forms(spark):
    forms = F.array(F.lit("Иванова"), F.lit("Иванов"))
    pick = lambda n, identity, value: spark.range(1).select(registry.form_at(forms, F.lit(n), F.lit(identity).cast("string"), F.lit(value).cast("string"))).first()[0]
    assert pick(0, "иванов", "x") == "Иванова" and pick(5, "иванов", "x") == "Иванов" and pick(5, "петров", "x") == "петров"
    assert pick(5, "pd:00", "x") == "x" and pick(5, None, None) == "Иванова"


def test_circles_and_forks_are_their_own_roots(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("f", "a"), ("f", "x"), ("d", "d")], "form string, base string")
    got = {r.form: r.root for r in dictionary.roots(edges).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "y", "f": "f", "d": "d"}


def test_blocked_channels_stop_the_settings():
    with pytest.raises(ValueError):
        policy.decide(F.lit("x"), ["SMS"])


def test_survivors_respect_letters_and_case(spark):
    df = spark.createDataFrame([("Анна Иванова пришла", "АННА  ИВАНОВА", 1), ("Анна Иванова пришла", "Анна Ивановаский", 0), ("Анна Иванова пришла", "", 0)], "original string, outgoing string, n int")
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(12).alias("end"), F.lit("P").alias("cls"), F.lit("Анна Иванова").alias("raw")))
    assert all(r.found == r.n for r in df.select("n", F.size(gate.survivors(F.col("original"), span, F.col("outgoing"))).alias("found")).collect())


def test_staged_versions_need_metrics(spark, tmp_path):
    live, fresh = str(tmp_path / "live"), spark.range(3)
    none = spark.createDataFrame([], "passed boolean")
    assert not training.apply_staged(spark, live, fresh, none, "1")
    assert training.apply_staged(spark, live, fresh, spark.createDataFrame([(True,)], "passed boolean"), "2")
    assert training.current(spark, live).count() == 3


def test_annotators_fail_quietly(spark):
    def broken():
        def find(_):
            raise RuntimeError("no model")

        return find

    texts = spark.createDataFrame([(1, "Анна"), (2, None)], "doc_id long, text string")
    assert [(r.spans, r.failed) for r in requests.annotated(texts, broken).collect()] == [([], True), ([], True)]


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "value string, code string")
    assert analytics.consistency(none).first()["values"] == 0
    assert analytics.k_anonymity(spark.createDataFrame([], "a string"), ["a"]).first().k_share == 0.0


def test_sql_functions(spark):
    requests.register_sql(spark, KEY)
    assert spark.sql("select norm_phone('8 (916) 123-45-67'), digits_of('a1b2'), norm_email('bad')").first()[:] == ("79161234567", "12", None)


def test_identities_that_never_wrote_one(spark):
    """A row without identity is of whom its value matches; a new identity never takes over another's value."""
    code = spark.range(1).select(codes.code(F.lit("P"), F.lit("иванов"), KEY, 0, 1)).first()[0]
    values = spark.createDataFrame([("P", "иванов", 1)], "cls string, identity string, first_seen int")
    for value, kept in (("«Иванов»", True), ("Петров", False), (None, False)):
        held = spark.createDataFrame([(code, None, value)], "token string, identity string, value string")
        assert (registry.assign(values, KEY, held, length=1, salts=640).first().token == code) == kept


def test_cascade_of_decisions(spark):
    """Each step of the decision on names: lower case, context, layer, veto, Latin letters, capitals, addresses."""
    words = scan.Vocabulary.of(terms=["абонемент"])
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    morphology = spark.createDataFrame([("роза", False, True), ("баланс", False, True)], "word string, is_name boolean, is_common boolean")
    forms_ = spark.createDataFrame([("крысова", "крысов")], "form string, base string")
    k = names.Knowledge(exact=one("Крысов", "Роза"), forms=forms_, layer=one("Анна"), morphology=morphology)
    cases = [
        ("Звонил Крысов", ["Крысов"]), ("звонил крысов", []), ("клиент крысов", ["крысов"]), ("для Крысова", ["Крысова"]), ("пришла Анна", []), ("клиент Анна", ["Анна"]),
        ("клиент Роза", []), ("mr Krysov", ["Krysov"]), ("ул. Крысова", []), ("Абонемент Крысов", ["Крысов"]), ("КРЫСОВ АННА", ["КРЫСОВ АННА"]), ("БАЛАНС РОЗА", []), ("Крысовский", []), ("", []), (None, []),
    ]
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: [s.raw for s in r.spans if s.cls == "P"] for r in engine.detect(texts, k, words).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_the_engine_merges_all_detectors(spark):
    text = "карта клиента 12345678, модель: Neo\nФИО;Телефон\n Иванов ;8 916 000-11-22"
    digests = dictionary.keyed(spark.createDataFrame([("C", "12345678"), ("I", "12345678")], "cls string, value string"), KEY)
    texts = spark.createDataFrame([(1, text), (2, None), (3, "a@b.ru")], "doc_id long, text string")
    at = text.index("Neo")
    model = spark.createDataFrame([(1, [(at, at + 3, "P", "Neo", "neo", "", 20, 0)])], f"doc_id long, spans array<{S.SPAN}>")
    done = engine.protect(texts, KEY, names.Knowledge(digests=digests, key=KEY), annotated=model)
    rows = {r.doc_id: r for r in done.texts.collect()}
    assert [(s.cls, s.norm) for s in rows[1].spans] == [("C", "12345678"), ("P", "neo"), ("P", "иванов"), ("T", "79160001122")]
    assert rows[2].masked is None and rows[2].spans == [] and rows[3].masked == rows[3].tokens[0]
    back = engine.answer(done.texts.select("doc_id", F.col("masked").alias("text")), done.registry, done.texts.select("doc_id", F.explode("tokens").alias("token"))).texts
    assert {r.doc_id: r.restored for r in back.collect()} == {1: text.replace(" Иванов ", "Иванов"), 2: None, 3: "a@b.ru"}
    assert {r.doc_id: r.clean for r in engine.verdict(done).collect()} == {1: True, 2: True, 3: True}
    own = scan.Vocabulary.of(phones="8 916 000-11-22")
    assert "T" not in [s.cls for s in engine.detect(texts.where("doc_id = 1"), words=own).first().spans]


def test_column_and_plain_forms_agree(spark):
    values = ["+7 (916) 123-45-67", "8 916 1234567", "", "Иванов. И.,  П", "«Пётр»", " A@b.RU ", "a@b", "0007", "12.03.85", "1985-13-01", "1/2/1930", "112-233-445 95", "500100732259", "1027700132195", "1700000000", "ул. Ленина, 5"]
    v = F.col("v")
    df = spark.createDataFrame([(x,) for x in values], "v string").select(
        "v", *(normalize.normalize(F.lit(c), v).alias(c) for c in "PTEAIC"), normalize.identity_key(v).alias("key"), normalize.split_birth_date(v).alias("date"), checks.snils_ok(v).alias("snils"), checks.inn_ok(v).alias("inn"),
        checks.ogrn_ok(v).alias("ogrn"), checks.ogrnip_ok(v).alias("ogrnip"), checks.is_epoch(v).alias("epoch"), codes.code(F.lit("P"), v, KEY, 3).alias("code"), codes.value_digest(F.lit("P"), v, KEY).alias("digest"),
    )
    for r in df.collect():
        assert [r[c] for c in "PTEAIC"] == [plain.normalize(c, r.v) for c in "PTEAIC"] and r.key == plain.identity_key(r.v), r.v
        assert (tuple(r.date) if r.date else None) == plain.split_birth_date(r.v)
        assert (r.snils, r.inn, r.ogrn, r.ogrnip, r.epoch) == (plain.snils_ok(r.v), plain.inn_ok(r.v), plain.ogrn_ok(r.v), plain.ogrnip_ok(r.v), plain.is_epoch(r.v)), r.v
        assert (r.code, r.digest) == (plain.code("P", r.v, KEY, 3), plain.value_digest("P", r.v, KEY))


def test_files_of_the_dictionary(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("a.csv", "first_name,last_name,middle_name\nАнна,Иванова,\n,Петров,Олегович\n")
    assert sorted(r.value for r in journals.name_zip(spark, str(tmp_path / "n.zip")).collect()) == ["Анна", "Иванова", "Олегович", "Петров"]
    (tmp_path / "layer.json").write_text('{"values": {"P": ["Анна", " "]}}')
    read = lambda s, p: journals.name_layer(s, p)
    layer = training.reloaded(spark, str(tmp_path / "layer.json"), read, None)
    assert [r.value for r in layer[0].collect()] == ["Анна"] and training.reloaded(spark, str(tmp_path / "layer.json"), read, layer)[0] is layer[0]
    (tmp_path / "layer.json").write_text('{"values": {}}')
    assert training.reloaded(spark, str(tmp_path / "layer.json"), read, layer, keep=True)[0] is layer[0]
    with pytest.raises(journals.JournalError):
        training.reloaded(spark, str(tmp_path / "layer.json"), read, layer)
    assert training.reloaded(spark, str(tmp_path / "gone.json"), read, layer) == (None, "")
    for bad in ('{"schema": 2, "keyed": true, "combos": []}', '{"schema": 1, "keyed": false, "combos": []}', '{"schema": 1, "keyed": true, "combos": ["Иванов"]}', "{"):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(journals.JournalError):
            journals.combo_index(spark, str(tmp_path / "c.json"))
    cards = spark.createDataFrame([(1, '{"surname": "Иванов", "name": " "}'), (2, '{"a": 1}'), (3, '{"surname": "Петров", "name": "Олег", "patronymic": "Ильич"}')], "page int, record string")
    assert sorted(r.parts for r in journals.name_cards(cards).collect()) == [["Иванов"], ["Петров", "Олег", "Ильич"]] and journals.name_cards(cards, 1).count() == 1


def test_settings_files():
    assert journals.overlay("a: 1 # one\nlist:\n  - x\n  - 'y z'\nflag: yes\n") == {"a": 1, "list": ["x", "y z"], "flag": True}
    assert journals.overlay('{"a": [1]}') == {"a": [1]}
    for bad in ("- x", "what is this"):
        with pytest.raises(journals.JournalError):
            journals.overlay(bad)


def test_audits_refuse_what_could_hold_a_value(spark, tmp_path):
    row = lambda channel: [("s", "blocked", "out", "P", 1, channel, "", datetime.datetime(2024, 1, 3))]
    events = lambda *c: spark.createDataFrame([x for k in c for x in row(k)], journals.AUDIT)
    journals.append_audit(events("web"), str(tmp_path / "a"))
    with pytest.raises(journals.JournalError):
        journals.append_audit(events("web", "Иванов"), str(tmp_path / "a"))
    assert journals.read_audit(spark, str(tmp_path / "a"), "2024-01-01", "2024-02-01").count() == 1 and journals.read_audit(spark, str(tmp_path / "a"), "2024-02-01", "2024-03-01").count() == 0
    (tmp_path / "file").write_text("")
    assert journals.append_incidents(events("web", "crm"), str(tmp_path / "file" / "x")) == 2


def test_words_of_a_deployment(spark):
    words = scan.Vocabulary.of(terms="абонемент", phrases=["до пятницы"], values=["гость"])
    for value, own in (("Абонемент Иванов", True), ("ГОСТЬ", True), ("Пётр до  пятницы", True), ("Иванов", False), ("", False)):
        assert words.owns(value) == own and spark.range(1).select(names.is_own_word(F.lit(value), words)).first()[0] == own
    assert [(r.category, r.word) for r in dictionary.lexicon(spark, {"A ": ["x  y", "", "X y"], "b": ["z"]}).collect()] == [("a", "x y"), ("b", "z")]


def test_spellings_of_latin_names():
    for latin, known in (("Krysov", "крысов"), ("Dostoevskiy", "достоевский"), ("Tchaikovsky", "тчаиковский"), ("Shcherbakova", "щербакова"), ("Solov'ev", "соловьев"), ("Alekseev", "алексеев"), ("Efimov", "эфимов")):
        assert known in [x.replace("ё", "е") for x in scan.spellings(latin)], (latin, scan.spellings(latin))
    assert scan.spellings(" ") == [] and all(len(scan.spellings(x)) <= scan.MOST_SPELLINGS for x in ("eieieieieiov", "owowowow"))
