"""Queries on the engine end to end: texts in, coded texts and a registry out, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import codes, normalize
from maskwright.functions.scan import Vocabulary
from maskwright.operators import dictionary, engine, names, registry, training
from maskwright.session import large, settled

from .cards import CARDS, KEY, NUMBER, PHONE_FORM, card_texts, cards, code_sql, digest_sql, rules

WORDS = Vocabulary.of(terms=["клиент", "имя", "абонемент"])
FORM = "surname || case id % 5 when 0 then 'у' when 1 then 'ым' when 2 then 'е' when 3 then 'а' else '' end"
#: A line with a name in some case, numbers in either spelling, the name again in capitals, and a table of one row.
TEXT = (
    f"'Клиент ' || {FORM} || '; телефон ' || {PHONE_FORM} || ', почта ' || email || '. Имя ' || given || '; договор № ' || {NUMBER} || chr(10)"
    " || 'и ещё раз ' || upper(surname) || ' пишет' || chr(10) || 'ФИО;Телефон' || chr(10) || surname || ';' || phone_a"
)
_GIVEN = "replace(lower(given), 'ё', 'е')"


def _masked_sql(surname: str, given: str) -> str:
    """What becomes of a line: the table's cell and the capitals are the same person in another case of letters."""
    t = code_sql("T", "phone")
    return f"""'Клиент ' || {surname} || '; телефон ' || {t} || ', почта ' || {code_sql('E', 'email')} || '. Имя ' || {given} || '; договор № ' || {code_sql('C', 'cast(id as varchar)')} || chr(10)
    || 'и ещё раз ' || {surname} || ' пишет' || chr(10) || 'ФИО;Телефон' || chr(10) || {surname} || ';' || {t}"""


def _readable(spark, sf) -> names.Knowledge:
    c = cards(spark, sf)
    surnames = c.select(F.col("surname").alias("value"), F.lit("lastname").alias("kind")).distinct()
    surnames = settled(surnames)
    return names.Knowledge(exact=surnames.select("value"), forms=settled(names.layer_bases(names.forms(surnames, rules(spark)))), layer=settled(c.select(F.col("given").alias("value")).distinct()))


def _keyed(spark, sf) -> names.Knowledge:
    """The same dictionary as digests alone: no name can be read in it."""
    c = cards(spark, sf)
    none = F.lit(None).cast("string")
    records = c.select("surname").distinct().select(
        none.alias("id"), "surname", none.alias("name"), none.alias("patronymic"), none.alias("phone"), none.alias("email"), none.alias("birth_date"), none.alias("address"),
        F.array().cast("array<struct<contact_type:string,contact:string>>").alias("contacts"),
    )
    digests, led = training.dictionary_of(records, rules(spark), KEY)
    return names.Knowledge(digests=settled(digests), form_digests=settled(led), layer=settled(c.select(F.col("given").alias("value")).distinct()), rules=rules(spark), key=KEY)


def _texts(spark, sf):
    return card_texts(spark, sf, f"id as doc_id, {TEXT} as text")


def protect_cards(spark, sf):
    """Cards through the whole engine: persons in any case form, numbers, mails and table cells, each identity by one code everywhere."""
    done = engine.protect(_texts(spark, sf), KEY, _readable(spark, sf), WORDS)
    return done.texts.select("doc_id", "masked", F.size("survivors").alias("survivors"))


def protect_keyed(spark, sf):
    """The same by a dictionary of digests: a person's code rests on a digest, whatever the case form."""
    done = engine.protect(_texts(spark, sf), KEY, _keyed(spark, sf), WORDS)
    return done.texts.select("doc_id", "masked", F.size("survivors").alias("survivors"))


KEYED_SQL = f"""
with c as (select *, 'pd:' || {digest_sql('P', 'lower(surname)')} as pd from ({CARDS}) x)
select id as doc_id, {_masked_sql(code_sql('P', 'pd'), code_sql('P', _GIVEN))} as masked, 0 as survivors from c
"""


def protect_registry(spark, sf):
    """The registry that the cards make: each code's class, identity, first value, and how many spellings came."""
    done = engine.protect(_texts(spark, sf), KEY, _readable(spark, sf), WORDS)
    return done.registry.where("cls in ('T', 'E', 'C')").select("token", "cls", "identity", "value", F.size("forms").alias("forms"))


REGISTRY_SQL = f"""
select {code_sql('T', 'phone')} as token, 'T' as cls, phone as identity, {PHONE_FORM} as value, case when id % 2 = 0 then 1 else 2 end as forms from ({CARDS}) c
union all select {code_sql('E', 'email')}, 'E', email, email, 1 from ({CARDS}) c
union all select {code_sql('C', 'cast(id as varchar)')}, 'C', cast(id as varchar), lpad(cast(id as varchar), greatest(5, length(cast(id as varchar)))::int, '0'), 1 from ({CARDS}) c
"""


def protect_counts(spark, sf):
    """Replacements and distinct values by class."""
    return engine.protect(_texts(spark, sf), KEY, _readable(spark, sf), WORDS).counts()


COUNTS_SQL = f"""
select 'T' as cls, count(*) * 2 as findings, count(*) as "values", 0 as moved from ({CARDS}) c union all select 'E', count(*), count(*), 0 from ({CARDS}) c union all select 'C', count(*), count(*), 0 from ({CARDS}) c
union all select 'P', count(*) * 4, count(distinct surname) + count(distinct given), 0 from ({CARDS}) c
"""


def answer_cards(spark, sf):
    """Coded texts restored from the registry they made, in copies that a model damaged: every value comes back in its first form."""
    done = engine.protect(card_texts(spark, sf, f"id as doc_id, 'почта ' || email || ', телефон ' || {PHONE_FORM} as text"), KEY)
    damaged = F.regexp_replace(F.regexp_replace("masked", "(zT[A-Z2-7]{4})([A-Z2-7]{4})", "$1-$2"), "(zE)([A-Z2-7]{8})", "$1 $2")
    texts = done.texts.select("doc_id", damaged.alias("text"))
    allowed = done.texts.select("doc_id", F.explode("tokens").alias("token"))
    return engine.answer(texts, done.registry, allowed).texts


def guard_modes(spark, sf):
    """Names side by side that no client has together: told in mode audit, kept as codes in mode enforce."""
    c = cards(spark, sf)
    p = lambda column: codes.code(F.lit("P"), normalize.identity_key(F.col(column)), KEY)
    texts = c.select(F.col("id").alias("doc_id"), F.concat(F.lit("пишет "), p("surname"), F.lit(" "), p("given"), F.lit(".")).alias("text"))
    row = lambda column: c.select(p(column).alias("token"), F.array(column).alias("forms"), normalize.identity_key(F.col(column)).alias("identity"), F.col(column).alias("value")).distinct()
    known = row("surname").unionByName(row("given"))
    allowed = c.select(F.col("id").alias("doc_id"), F.explode(F.array(p("surname"), p("given"))).alias("token"))
    combos = dictionary.combos(c.where("surname < 'П'").select(F.array("surname", "given").alias("parts")), KEY)
    out = None
    for mode in engine.GUARDS:
        done = engine.answer(texts, known, allowed, mode, combos, KEY)
        n = done.incidents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("incidents"))
        rows = done.texts.join(n, "doc_id", "left").select(F.lit(mode).alias("mode"), "doc_id", "restored", F.coalesce("incidents", F.lit(0)).alias("incidents"))
        out = rows if out is None else out.unionByName(rows)
    return out


GUARD_SQL = f"""
with c as (select *, surname >= 'П' as bad from ({CARDS}) x)
select mode, id as doc_id, 'пишет ' || case when mode = 'enforce' and bad then {code_sql('P', 'lower(surname)')} || ' ' || {code_sql('P', _GIVEN)} else surname || ' ' || given end || '.' as restored,
    case when mode <> 'off' and bad then 2 else 0 end as incidents
from c, (select unnest(['off', 'audit', 'enforce']) as mode) m
"""


def dry_run(spark, sf):
    """Request bodies as they would go out: leaves by their key, texts by all detectors, JSON within strings; nothing is sent."""
    inner = F.to_json(F.struct(F.col("phone_b").alias("phone")))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("клиент "), F.col("surname"), F.lit("у; почта "), F.col("email")).alias("content")), F.struct(F.lit("tool").alias("role"), inner.alias("content"))).alias("messages"), F.col("id").alias("client_id")))
    bodies = cards(spark, sf).select(F.col("id").alias("req_id"), body.alias("body"))
    return engine.protect_bodies(bodies, KEY, _readable(spark, sf), WORDS)[0]


DRY_SQL = rf"""
select id as req_id, '{{"model": "m", "messages": [{{"role": "user", "content": "клиент ' || {code_sql('P', 'lower(surname)')} || '; почта ' || {code_sql('E', 'email')}
    || '"}}, {{"role": "tool", "content": "{{\"phone\": \"' || {code_sql('T', 'phone')} || '\"}}"}}], "client_id": "' || {code_sql('C', 'cast(id as varchar)')} || '"}}' as body
from ({CARDS}) c
"""


def residual_findings(spark, sf):
    """What all detectors still find in coded texts: the telephones of every ninth card, which were written before it."""
    done = engine.protect(_texts(spark, sf), KEY, _readable(spark, sf), WORDS).texts
    sent = done.join(large(cards(spark, sf, "id as doc_id, phone_a")), "doc_id").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat("phone_a", F.lit(" "), "masked")).otherwise(F.col("masked")).alias("text"))
    return engine.residual(sent, _readable(spark, sf), WORDS)


def second_day(spark, sf):
    """Texts met again with the registry of the day before: old identities keep their codes and first values, new ones are added."""
    half = card_texts(spark, sf, f"id as doc_id, 'почта ' || email || ', телефон ' || {PHONE_FORM} as text")
    first = engine.protect(half.where("doc_id % 2 = 0"), KEY).registry.drop("salt")
    after = cards(spark, sf, "id as doc_id, 'пишите на ' || upper(email) as text")
    fresh = engine.protect(after, KEY, known=first).registry.drop("salt")
    return registry.upsert(first, fresh).select("token", "identity", "value", F.array_join("forms", ",").alias("forms"))


SECOND_SQL = f"""
select {code_sql('E', 'email')} as token, email as identity, case when id % 2 = 0 then email else upper(email) end as value, case when id % 2 = 0 then email || ',' || upper(email) else upper(email) end as forms from ({CARDS}) c
union all select {code_sql('T', 'phone')}, phone, {PHONE_FORM}, {PHONE_FORM} from ({CARDS}) c where id % 2 = 0
"""

QUERIES = [
    ("protect_cards", protect_cards, f"select id as doc_id, {_masked_sql(code_sql('P', 'lower(surname)'), code_sql('P', _GIVEN))} as masked, 0 as survivors from ({CARDS}) c"),
    ("protect_keyed", protect_keyed, KEYED_SQL),
    ("protect_registry", protect_registry, REGISTRY_SQL),
    ("protect_counts", protect_counts, COUNTS_SQL),
    ("answer_cards", answer_cards, f"select id as doc_id, 'почта ' || email || ', телефон ' || {PHONE_FORM} as restored, 2 as replaced from ({CARDS}) c"),
    ("guard_modes", guard_modes, GUARD_SQL),
    ("dry_run", dry_run, DRY_SQL),
    ("residual_findings", residual_findings, f"select 'T' as cls, count(*) as findings from ({CARDS}) c where id % 9 = 0"),
    ("second_day", second_day, SECOND_SQL),
]
