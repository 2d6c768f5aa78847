"""Queries on detection, canonical forms, checks, codes and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import checks, codes, normalize
from maskwright.functions import spans as S
from maskwright.operators import detect, gate, names, payload, tokenise
from maskwright.session import spread, table

from .cards import CARDS, CARD_TEXT, KEY, PHONE_FORM, card_texts, cards, code_sql, digest_sql, hmac_sql

_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_MAILS_SQL = f"select doc_id, text, regexp_extract_all(text, '{_MAIL}') as v, string_split_regex(text, '{_MAIL}') as g from documents"


def email_spans(spark, sf):
    docs = table(spark, sf, "documents").where(F.contains("text", F.lit("@")))
    return tokenise.long_form(docs.select("doc_id", detect.emails(F.col("text")).alias("spans")), ["doc_id"])


def email_tokenize_documents(spark, sf):
    docs = table(spark, sf, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", "text")
    out = tokenise.tokenise(docs, KEY, detector=detect.emails).where(F.size("spans") > 0)
    return out.select("doc_id", F.size("spans").alias("findings"), F.sha2("masked", 256).alias("masked_sha256"))


def email_class_counts(spark, sf):
    docs = table(spark, sf, "documents").select("lang", detect.emails(F.col("text")).alias("spans"))
    return tokenise.class_counts(docs, ["lang"])


def rule_class_counts(spark, sf):
    """All rule detectors over whole documents, counted by class and language."""
    docs = table(spark, sf, "documents")
    return tokenise.class_counts(tokenise.with_spans(spread(docs.select("lang", "text"), docs)), ["lang"])


def number_runs(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").rlike("[0-9]{7}"))
    return docs.select("doc_id", F.explode(detect.number_runs(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.max("s.raw").alias("largest"))


def _card_texts(spark, sf):
    return card_texts(spark, sf, f"*, {CARD_TEXT} as text")


def card_spans(spark, sf):
    return tokenise.long_form(tokenise.with_spans(_card_texts(spark, sf).select("id", "text")), ["id"]).drop("raw")


def card_tokenize(spark, sf):
    out = tokenise.tokenise(_card_texts(spark, sf).select("id", "text"), KEY)
    return out.select("id", F.col("masked"))


_T = f"""
with c as (select *, {PHONE_FORM} as pf from ({CARDS}) x),
p as (select *, 8 + length(surname) + 1 + length(given) + 10 as t0 from c),
q as (select *, t0 + length(pf) + 8 as e0 from p),
r as (select *, e0 + length(email) + 16 as d0 from q),
s as (select *, d0 + 10 + 12 as k0 from r)
"""
CARD_SPANS_SQL = _T + """
select id, 0 as ord, t0 as start, t0 + length(pf) as "end", 'T' as cls, phone as norm from s
union all select id, 1, e0, e0 + length(email), 'E', email from s
union all select id, 2, d0, d0 + 5, 'D', substr(birth, 1, 5) from s
union all select id, 3, k0, k0 + 5 + greatest(length(cast(id as varchar)) - 5, 0), 'C', cast(id as varchar) from s
"""
CARD_TOKENIZE_SQL = _T + f"""
select id, 'Анкета: ' || surname || ' ' || given || ', телефон ' || {code_sql('T', 'phone')} || ', почта ' || {code_sql('E', 'email')} || ', дата рождения '
    || {code_sql('D', 'substr(birth, 1, 5)')} || substr(birth, 6) || '. client_id=' || {code_sql('C', 'cast(id as varchar)')} as masked
from s
"""


def tabular_spans(spark, sf):
    """A pasted table of four clients, one per group of customers; spans of its cells."""
    rows = F.array_join(F.array_sort(F.collect_list(F.concat_ws(";", "surname", "phone", "email", "birth"))), "\n")
    tables = cards(spark, sf).groupBy((F.col("id") % 200).alias("g")).agg(F.concat(F.lit("ФИО;Телефон;E-mail;Дата рождения\n"), rows).alias("text"))
    return tables.select("g", F.explode(detect.tabular(F.col("text"))).alias("s")).groupBy("g", "s.cls").agg(F.count(F.lit(1)).alias("findings"), F.min("s.norm").alias("least"))


TABULAR_SQL = f"""
with c as (select id % 200 as g, * from ({CARDS}) x)
select g, 'P' as cls, count(*) as findings, min(lower(surname)) as least from c group by g
union all select g, 'T', count(*), min(phone) from c group by g
union all select g, 'E', count(*), min(email) from c group by g
union all select g, 'D', count(*), min(substr(birth, 1, 5)) from c group by g
"""


def identifier_spans(spark, sf):
    """Documents of seven kinds, an address, and numbers like them that are none, found by all rules."""
    c = spark.sql(IDENTIFIERS.replace("from customer", "from {customer}"), customer=table(spark, sf, "customer"))
    return tokenise.long_form(tokenise.with_spans(c.select("id", "text")), ["id"]).drop("ord")


def ru_identifiers(spark, sf):
    """The same numbers by the detector of Russian identifiers alone, with the kind that it took each for."""
    c = spark.sql(IDENTIFIERS.replace("from customer", "from {customer}"), customer=table(spark, sf, "customer"))
    found = c.select("id", detect.ru_ids(F.col("text")).alias("spans"))
    return found.select("id", F.explode("spans").alias("s")).select("id", F.col("s.suffix").alias("kind"), "s.norm")


def _digit_sql(n: str, i: int) -> str:
    return f"cast(substr({n}, {i + 1}, 1) as int)"


def _check_sql(n: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{_digit_sql(n, i)} * {w}" for i, w in enumerate(weights)) + ")"


_A, _B = checks.INN12_WEIGHTS
IDENTIFIERS = f"""
select id, k, before || number || after as text, length(before) as start, number, place from (
    select id, k, place,
        case k when 0 then 'паспорт ' when 1 then 'кпп ' when 2 then 'бик ' when 3 then 'счёт ' when 4 then 'полис ' when 5 then 'снилс ' when 6 then 'номер ' when 7 then 'живёт на ' else 'число ' end as before,
        case k when 0 then lpad(cast(id % 100 as string), 2, '4') || ' 10 ' || lpad(cast(id as string), 6, '1') when 1 then lpad(cast(id as string), 9, '7') when 2 then '04' || lpad(cast(id as string), 7, '4')
            when 3 then lpad(cast(id as string), 20, '8') when 4 then lpad(cast(id as string), 16, '3')
            when 5 then substr(s, 1, 3) || '-' || substr(s, 4, 3) || '-' || substr(s, 7, 3) || ' ' || lpad(cast({_check_sql('s', checks.SNILS_WEIGHTS)} % 101 % 100 as string), 2, '0')
            when 6 then n11 || cast({_check_sql('n11', _B)} % 11 % 10 as string) when 7 then place else lpad(cast(id as string), 9, '7') end as number,
        case k when 7 then '; да' else ' и всё' end as after
    from (
        select *, n10 || cast({_check_sql('n10', _A)} % 11 % 10 as string) as n11
        from (select c_custkey as id, c_custkey % 9 as k, lpad(cast(c_custkey as string), 9, '1') as s, lpad(cast(c_custkey as string), 10, '5') as n10, 'ул. Лесная д. ' || cast(c_custkey as string) as place from customer) q
    ) r
) t
"""
IDENTIFIERS_SQL = f"""
select id, start, start + length(number) as "end", case k when 7 then 'A' else 'I' end as cls, number as raw,
    case k when 7 then 'ул лесная д ' || cast(id as varchar) else regexp_replace(number, '[^0-9]', '', 'g') end as norm
from ({IDENTIFIERS.replace('as string', 'as varchar')}) x where k <> 8
"""
KINDS_SQL = f"""
select id, case k when 0 then 'паспорт' when 1 then 'кпп' when 2 then 'кпп' when 3 then 'расчётный счёт' when 4 then 'полис ОМС' when 5 then 'снилс' else 'инн' end as kind, regexp_replace(number, '[^0-9]', '', 'g') as norm
from ({IDENTIFIERS.replace('as string', 'as varchar')}) x where k < 7
"""


def normalize_values(spark, sf):
    c = cards(spark, sf)
    return c.select(
        "id", normalize.phone(F.expr(PHONE_FORM)).alias("phone"), normalize.phone(F.substring("phone", 2, 10)).alias("phone10"), normalize.email(F.concat(F.lit("  "), F.upper("email"))).alias("email"),
        normalize.name(F.concat_ws(". ", "surname", "given")).alias("name"), normalize.client_id(F.lpad(F.col("id").cast("string"), 9, "0")).alias("client"),
        normalize.document(F.concat_ws("-", F.col("id").cast("string"), F.lit("1"))).alias("document"), normalize.address(F.concat(F.lit("ул. "), "surname", F.lit(",  д. "), F.col("id").cast("string"))).alias("address"),
        normalize.identity_key(F.concat(F.lit("«"), "given", F.lit(" "), "surname", F.lit("».")))
        .alias("identity"),
    )


NORMALIZE_SQL = f"""
select id, phone, phone as phone10, email, lower(surname) || ' ' || lower(given) as name, cast(id as varchar) as client,
    case when length(cast(id as varchar)) >= 4 then cast(id as varchar) || '1' end as document,
    'ул ' || lower(surname) || ' д ' || cast(id as varchar) as address, replace(lower(given), 'ё', 'е') || ' ' || lower(surname) as identity
from ({CARDS}) c
"""


def split_birth_dates(spark, sf):
    c = cards(spark, sf, "id, case when id % 3 = 0 then birth when id % 3 = 1 then substr(birth, 7, 4) || '-' || substr(birth, 4, 2) || '-' || substr(birth, 1, 2) else replace(substr(birth, 1, 6) || substr(birth, 9, 2), '.', '/') end as raw")
    d = normalize.split_birth_date(F.col("raw"))
    return c.select("id", d["day_month"].alias("day_month"), d["year"].alias("year"))


BIRTH_SQL = f"""
select id, substr(birth, 1, 5) as day_month, case when id % 3 = 2 then case when cast(substr(birth, 9, 2) as int) > 30 then '19' else '20' end || substr(birth, 9, 2) else substr(birth, 7, 4) end as year
from ({CARDS}) c
"""


def checksums(spark, sf):
    """Check digits of numbers made from order keys, right and wrong."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    pad = lambda n: F.lpad(F.col("k").cast("string"), n, "7")
    return o.select(
        "k", checks.snils_ok(pad(11)).alias("snils"), checks.inn10_ok(pad(10)).alias("inn10"), checks.inn12_ok(pad(12)).alias("inn12"),
        checks.ogrn_ok(pad(13)).alias("ogrn"), checks.ogrnip_ok(pad(15)).alias("ogrnip"), checks.is_epoch(pad(10)).alias("epoch"),
    )


def _sum_sql(n: int, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"cast(substr(d{n}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights)) + ")"


_PADS = ", ".join(f"lpad(cast(o_orderkey as varchar), {n}, '7') as d{n}" for n in (10, 11, 12, 13, 15))
_SN = f"({_sum_sql(11, checks.SNILS_WEIGHTS)} % 101)"
CHECKSUMS_SQL = f"""
with d as (select o_orderkey as k, {_PADS} from orders)
select k, (case when {_SN} = 100 then 0 else {_SN} end) = cast(substr(d11, 10, 2) as int) as snils,
    {_sum_sql(10, checks.INN10_WEIGHTS)} % 11 % 10 = cast(substr(d10, 10, 1) as int) as inn10,
    {_sum_sql(12, checks.INN12_WEIGHTS[0])} % 11 % 10 = cast(substr(d12, 11, 1) as int) and {_sum_sql(12, checks.INN12_WEIGHTS[1])} % 11 % 10 = cast(substr(d12, 12, 1) as int) as inn12,
    cast(substr(d13, 1, 12) as bigint) % 11 % 10 = cast(substr(d13, 13, 1) as int) as ogrn,
    cast(substr(d15, 1, 14) as bigint) % 13 % 10 = cast(substr(d15, 15, 1) as int) as ogrnip,
    cast(d10 as bigint) between 1000000000 and 2300000000 as epoch
from d
"""


def keyed_codes(spark, sf):
    c = cards(spark, sf)
    salt3 = codes.code(F.lit("T"), F.col("phone"), KEY, 3)
    return c.select(
        "id", codes.code(F.lit("T"), F.col("phone"), KEY).alias("code"), salt3.alias("code3"), F.array_position(codes.candidates(F.lit("T"), F.col("phone"), KEY, 6), salt3).cast("int").alias("place"),
        codes.value_digest(F.lit("E"), F.col("email"), KEY).alias("digest"), codes.combo_digest(F.array(F.lower("surname"), F.lower("given")), KEY).alias("combo"), codes.hmac_hex(F.col("surname"), KEY).alias("hmac"),
    )


CODES_SQL = f"""
select id, {code_sql('T', 'phone')} as code, {code_sql('T', 'phone', " || '#3'")} as code3, 4 as place, {digest_sql('E', 'email')} as digest,
    {digest_sql('P', "least(lower(surname), lower(given)) || '|' || greatest(lower(surname), lower(given))")} as combo, {hmac_sql('surname')} as hmac
from ({CARDS}) c
"""


def code_surfaces(spark, sf):
    """Surfaces of codes, true and false, brought to their canonical form."""
    c = cards(spark, sf).select("id", F.substring(codes.code(F.lit("T"), F.col("phone"), KEY), 3, 8).alias("b"))
    surface = F.when(F.col("id") % 5 == 0, F.lower(F.concat(F.lit("zt"), "b"))).when(F.col("id") % 5 == 1, F.concat(F.lit("⟦P-"), "b", F.lit("ABCD⟧"))).when(F.col("id") % 5 == 2, F.concat(F.lit("E-"), "b", F.lit("2345"))).when(F.col("id") % 5 == 3, F.concat(F.lit("[[C-"), "b", F.lit("WXYZ]]"))).otherwise(F.concat(F.lit("zx"), "b"))
    return c.select("id", codes.is_code(surface).alias("is_code"), codes.canonical(surface).alias("canonical"))


SURFACES_SQL = f"""
with c as (select id, substr({code_sql('T', 'phone')}, 3, 8) as b from ({CARDS}) x)
select id, id % 5 < 4 as is_code, case id % 5 when 0 then 'zT' || b when 1 then '[[P-' || b || 'ABCD]]' when 2 then '[[E-' || b || '2345]]' when 3 then '[[C-' || b || 'WXYZ]]' end as canonical
from c
"""


def code_spans(spark, sf):
    """Codes found in a text in three surfaces, one of them glued to a letter and so none."""
    c = cards(spark, sf).select("id", codes.code(F.lit("T"), F.col("phone"), KEY).alias("c"))
    text = F.concat(F.lit("a "), "c", F.lit(", б"), "c", F.lit(" [[P-ABCDEFGH2345]] E-ABCDEFGH2345."))
    return c.select("id", F.explode(detect.code_spans(text)).alias("s")).select("id", "s.start", "s.end", "s.cls", "s.norm")


CODE_SPANS_SQL = f"""
select id, 2 as start, 12 as "end", 'T' as cls, {code_sql('T', 'phone')} as norm from ({CARDS}) c
union all select id, 26, 44, 'P', '[[P-ABCDEFGH2345]]' from ({CARDS}) c
union all select id, 45, 59, 'E', '[[E-ABCDEFGH2345]]' from ({CARDS}) c
"""


def merge_spans(spark, sf):
    """Spans made from line items, up to seven an order, merged: earliest first, then longest, then by class."""
    item = S.span((F.col("l_partkey") % 40).cast("int"), (F.col("l_partkey") % 40 + F.col("l_suppkey") % 13).cast("int"), F.substring(F.lit("PTEDAIC"), (F.col("l_linenumber") % 7 + 1).cast("int"), F.lit(1)), F.lit(""), F.lit(""), 0, F.col("l_linenumber"))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("spans"))
    return per.select("l_orderkey", F.posexplode_outer(S.merge(F.col("spans"))).alias("place", "s")).where("s is not null").select("l_orderkey", "place", "s.start", "s.end", "s.cls")


MERGE_SQL = """
with recursive s as (
    select l_orderkey, (l_partkey % 40)::int as a, (l_partkey % 40 + l_suppkey % 13)::int as b, substr('PTEDAIC', (l_linenumber % 7)::int + 1, 1) as cls, l_linenumber as o from lineitem
), n as (
    select *, row_number() over (partition by l_orderkey order by a, b desc, cls, o) as i from s where b > a
), m as (
    select l_orderkey, i, a, b, cls, b as last, true as ok, 0 as place from n where i = 1
    union all
    select n.l_orderkey, n.i, n.a, n.b, n.cls, case when n.a >= m.last then n.b else m.last end, n.a >= m.last, m.place + case when n.a >= m.last then 1 else 0 end
    from m join n on n.l_orderkey = m.l_orderkey and n.i = m.i + 1
)
select l_orderkey, place, a as start, b as "end", cls from m where ok
"""


def second_pass(spark, sf):
    """What the first pass left of a value, in other case and spacing, gets the same code; parts of longer words stay."""
    c = cards(spark, sf).select("id", "surname", "given")
    raw = F.concat_ws(" ", "surname", "given")
    spans = F.array(S.span(F.lit(0), F.length(raw), F.lit("P"), raw, F.lower(raw), 0, F.lit(0)))
    text = F.concat(F.upper("surname"), F.lit("  "), F.upper("given"), F.lit("; "), "surname", F.lit(" "), "given", F.lit("ский"))
    return c.select("id", tokenise.second_pass(text, spans, tokenise.first_codes(spans, KEY)).alias("masked"))


SECOND_SQL = f"select id, {code_sql('P', "(lower(surname) || ' ' || lower(given))")} || '; ' || surname || ' ' || given || 'ский' as masked from ({CARDS}) c"


def gate_survivors(spark, sf):
    """Every third card goes out with its telephone still readable in other spacing; the gate finds these and no others."""
    c = _card_texts(spark, sf)
    t = tokenise.tokenise(c.select("id", "text", F.expr(PHONE_FORM).alias("pf")), KEY)
    leaky = F.when(F.col("id") % 3 == 0, F.concat("masked", F.lit(" "), F.replace("pf", F.lit(" "), F.lit("  ")))).otherwise(F.col("masked"))
    checked = t.select("id", F.col("text").alias("original"), "spans", leaky.alias("outgoing"))
    found = checked.withColumn("survivors", gate.survivors(F.col("original"), F.col("spans"), F.col("outgoing")))
    v = gate.verdict(found.select("id", "original", "survivors"), ["id"])
    return v.select("id", "clean", F.get("reasons", F.lit(0))["cls"].alias("cls"), F.get("reasons", F.lit(0))["findings"].alias("findings"), F.get(F.get("reasons", F.lit(0))["samples"], F.lit(0)).alias("sample"))


GATE_SQL = _T + """
select id, id % 3 <> 0 as clean, case when id % 3 = 0 then 'T' end as cls, case when id % 3 = 0 then 1 end as findings,
    case when id % 3 = 0 then substr(pf, 1, 2) || '…(' || length(pf) || ') | '
        || regexp_replace(substr('Анкета: ' || surname || ' ' || given || ', телефон ' || pf || ', почта ' || email || ', дата рождения ' || birth,
            greatest(0, t0 - 25) + 1, t0 - greatest(0, t0 - 25) + length(pf) + 25), '[0-9A-Za-zА-Яа-яЁё_]', '•', 'g') end as sample
from s
"""


def repair_outgoing(spark, sf):
    """After repair no value of a card is readable; the repaired text holds its telephone's code."""
    c = _card_texts(spark, sf).select("id", "text", "phone", F.expr(PHONE_FORM).alias("pf"))
    t = tokenise.tokenise(c, KEY).withColumnRenamed("text", "original").withColumn("outgoing", F.concat("masked", F.lit(" "), "pf"))
    done = gate.repair(t, tokenise.first_codes(F.col("spans"), KEY))
    return done.select("id", F.size("survivors").alias("left"), F.substring_index("outgoing", " ", -1).alias("tail"))


REPAIR_SQL = f"select id, 0 as left, {code_sql('T', 'phone')} as tail from ({CARDS}) c"


def link_exception(spark, sf):
    """Values glued to a link are no survivors."""
    c = cards(spark, sf).select("id", "email")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://x.ru/?m="), "email")).otherwise(F.concat(F.lit("mail "), "email", F.lit(" end")))
    d = c.select("id", text.alias("text"), detect.emails(text).alias("spans"))
    return d.select("id", F.size(gate.survivors(F.col("text"), F.col("spans"), F.col("text"))).alias("survivors"))


LINK_SQL = f"select id, case when id % 2 = 0 then 0 else 1 end as survivors from ({CARDS}) c"


def unmasked_residue(spark, sf):
    """Findings in outgoing texts beside their codes, by class: telephones of every fourth card."""
    t = tokenise.tokenise(_card_texts(spark, sf), KEY)
    out = F.when(F.col("id") % 4 == 0, F.concat("masked", F.lit("; тел "), "phone_a")).otherwise(F.col("masked"))
    # a column of its own: detectors name their text many times
    return tokenise.class_counts(t.select(out.alias("outgoing")).select(gate.unmasked(F.col("outgoing")).alias("spans")))


UNMASKED_SQL = f"select 'T' as cls, count(*) as findings from ({CARDS}) c where id % 4 = 0"


def json_leaves(spark, sf):
    """Leaves of the events' JSON."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("req_id"), F.col("props").alias("body"))
    return payload.leaves(e).select("req_id", "path", "ord", "name", "text")


LEAVES_SQL = """select event_id as req_id, '$."k"' as path, 0 as ord, 'k' as name, json_extract_string(props, '$.k') as text from events"""


def forced_keys(spark, sf):
    """Leaves whose key forces a class, with contacts typed by their neighbours and names outside tool calls."""
    body = F.to_json(F.struct(
        F.col("phone").alias("phone"), F.col("id").alias("client_id"), F.col("given").alias("name"), F.array(F.struct(F.lit("email").alias("contact_type"), F.col("email").alias("contact"))).alias("contacts"),
        F.struct(F.col("given").alias("name")).alias("function"), F.lit(True).alias("birth_date"),
    ))
    found = payload.leaves(cards(spark, sf).select(F.col("id").alias("req_id"), body.alias("body")))
    cls = payload.forced_class(F.col("name"), F.col("text"), F.col("tool"), F.col("contact"))
    return found.select("req_id", "ord", cls.alias("cls"), "text").where("cls is not null")


FORCED_SQL = f"""
select id as req_id, 0 as ord, 'T' as cls, phone as text from ({CARDS}) c union all select id, 1, 'C', cast(id as varchar) from ({CARDS}) c
union all select id, 2, 'P', given from ({CARDS}) c union all select id, 4, 'E', email from ({CARDS}) c
"""


def payload_round_trip(spark, sf):
    """Bodies with their telephone leaf coded and put together again, keys in order, embedded JSON too."""
    inner = F.to_json(F.struct(F.col("phone").alias("phone"), F.lit(1).alias("n")))
    body = F.to_json(F.struct(F.lit("user").alias("role"), inner.alias("arguments")))
    b = cards(spark, sf).select(F.col("id").alias("req_id"), body.alias("body"))
    found = payload.leaves(b).where("name = 'phone'")
    changed = found.select("req_id", "path", codes.code(F.lit("T"), normalize.phone(F.col("text")), KEY).alias("text"))
    return payload.put_back(b, changed)


ROUND_SQL = rf"""select id as req_id, '{{"role": "user", "arguments": "{{\"phone\": \"' || {code_sql('T', 'phone')} || '\", \"n\": 1}}"}}' as body from ({CARDS}) c"""


def birth_date_codes(spark, sf):
    c = cards(spark, sf, "id, case when id % 2 = 0 then birth else substr(birth, 7, 4) || '-' || substr(birth, 4, 2) || '-' || substr(birth, 1, 2) end as raw")
    return c.select("id", payload.birth_date_code(F.col("raw"), lambda d: codes.code(F.lit("D"), d, KEY)).alias("coded"))


BIRTH_CODES_SQL = f"select id, case when id % 2 = 0 then {code_sql('D', 'substr(birth, 1, 5)')} || substr(birth, 6) else substr(birth, 7, 4) || '-' || {code_sql('D', 'substr(birth, 1, 5)')} end as coded from ({CARDS}) c"


def tolerant_codes(spark, sf):
    """Codes copied with separators or look-alike letters inside are found again."""
    c = cards(spark, sf).select("id", codes.code(F.lit("T"), F.col("phone"), KEY).alias("c"))
    damaged = F.when(F.col("id") % 3 == 0, F.concat(F.substring("c", 1, 4), F.lit("-"), F.substring("c", 5, 6))).when(F.col("id") % 3 == 1, F.translate("c", "OB", "08")).otherwise(F.concat_ws(" ", F.substring("c", 1, 5), F.substring("c", 6, 5)))
    return c.select("id", F.explode(detect.code_spans(F.concat(F.lit("код "), damaged, F.lit("!")))).alias("s")).select("id", "s.start", "s.end", "s.norm")


TOLERANT_SQL = f"select id, 4 as start, case when id % 3 = 1 then 14 else 15 end as \"end\", {code_sql('T', 'phone')} as norm from ({CARDS}) c"


def name_shapes(spark, sf):
    """Surname and given name, and surname with initials, told by shape; none after a street marker's words of trade."""
    c = cards(spark, sf)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("звонил "), "surname", F.lit(" "), "given")).otherwise(F.concat(F.lit("от "), "surname", F.lit(" "), F.substring("given", 1, 1), F.lit(".")))
    return c.select("id", F.explode(names.shapes(text)).alias("s")).select("id", "s.start", "s.norm")


_SHAPED = "(surname like '%ов' or surname like '%ев' or surname like '%ин')"
SHAPES_SQL = f"select id, case when id % 2 = 0 then 7 else 3 end as start, case when id % 2 = 0 then lower(surname) || ' ' || lower(given) else lower(surname) || ' ' || lower(substr(given, 1, 1)) end as norm from ({CARDS}) c where {_SHAPED}"

SPANS_SQL = f"""
with m as ({_MAILS_SQL})
select doc_id, i - 1 as ord, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::bigint as start,
    (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x))))::bigint as "end", 'E' as cls, v[i] as raw, lower(v[i]) as norm
from (select *, unnest(range(1, len(v) + 1)) as i from m) q
"""
TOKENIZE_SQL = f"""
with m as ({_MAILS_SQL})
select doc_id, len(v)::int as findings, sha256(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || case when i <= len(v) then {code_sql('E', 'lower(v[i])')} else '' end), '')) as masked_sha256
from m where len(v) > 0
"""
RUNS_SQL = r"""
select doc_id, count(*) as runs, max(r) as largest from (
    select doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) between 7 and 12)) as r from documents
) q group by doc_id
"""

QUERIES = [
    ("email_spans", email_spans, SPANS_SQL),
    ("email_tokenize_documents", email_tokenize_documents, TOKENIZE_SQL),
    ("email_class_counts", email_class_counts, f"select lang, 'E' as cls, sum(len(regexp_extract_all(text, '{_MAIL}')))::bigint as findings from documents where regexp_matches(text, '{_MAIL}') group by lang"),
    ("rule_class_counts", rule_class_counts, None),
    ("identifier_spans", identifier_spans, IDENTIFIERS_SQL),
    ("ru_identifiers", ru_identifiers, KINDS_SQL),
    ("number_runs", number_runs, RUNS_SQL),
    ("card_spans", card_spans, CARD_SPANS_SQL),
    ("card_tokenize", card_tokenize, CARD_TOKENIZE_SQL),
    ("tabular_spans", tabular_spans, TABULAR_SQL),
    ("normalize_values", normalize_values, NORMALIZE_SQL),
    ("split_birth_dates", split_birth_dates, BIRTH_SQL),
    ("checksums", checksums, CHECKSUMS_SQL),
    ("keyed_codes", keyed_codes, CODES_SQL),
    ("code_surfaces", code_surfaces, SURFACES_SQL),
    ("code_spans", code_spans, CODE_SPANS_SQL),
    ("merge_spans", merge_spans, MERGE_SQL),
    ("second_pass", second_pass, SECOND_SQL),
    ("gate_survivors", gate_survivors, GATE_SQL),
    ("repair_outgoing", repair_outgoing, REPAIR_SQL),
    ("link_exception", link_exception, LINK_SQL),
    ("unmasked_residue", unmasked_residue, UNMASKED_SQL),
    ("json_leaves", json_leaves, LEAVES_SQL),
    ("forced_keys", forced_keys, FORCED_SQL),
    ("payload_round_trip", payload_round_trip, ROUND_SQL),
    ("birth_date_codes", birth_date_codes, BIRTH_CODES_SQL),
    ("tolerant_codes", tolerant_codes, TOLERANT_SQL),
    ("name_shapes", name_shapes, SHAPES_SQL),
]
