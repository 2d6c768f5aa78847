"""Queries on what can be read back, and on the engine's quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import codes
from maskwright.operators import analytics, engine, gate, names, registry, tokenise
from maskwright.session import table

from .cards import CARD_TEXT, CARDS, CUT_TEXT, KEY, PHONE_FORM, cards, coded, rules


def _coded(spark, sf, extra: str = ""):
    return tokenise.tokenise(cards(spark, sf, f"*, {PHONE_FORM} as pf, {CARD_TEXT}{extra} as text"), KEY)


def k_anonymity(spark, sf):
    records = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return analytics.k_anonymity(records, ["c_mktsegment", "c_nationkey", "o_orderpriority"])


K_SQL = """
select count(*) as groups, count(*) filter (n < 5) as below_k, count(*) filter (n = 1) as singled_out, count(*) filter (n < 5) / count(*) as k_share
from (select count(*) as n from orders join customer on o_custkey = c_custkey group by c_mktsegment, c_nationkey, o_orderpriority) q
"""


def direct_lookup(spark, sf):
    """Attempts to find each client's own values in its coded card; every tenth card leaks its e-mail."""
    t = _coded(spark, sf).withColumn("outgoing", F.when(F.col("id") % 10 == 0, F.concat("masked", F.lit(" "), "email")).otherwise(F.col("masked")))
    return analytics.direct_lookup(t, {"phone": "T", "email": "E", "pf": "T"})


DIRECT_SQL = f"""
select f as field, count(*) as attempts, count(*) filter (f = 'email' and id % 10 = 0) as successes from ({CARDS}) c, (select unnest(['phone', 'email', 'pf']) as f) x group by f
"""


def dictionary_linkage(spark, sf):
    """Values found in a dictionary as they stand or by plain hash: keyed digests give none away."""
    c = cards(spark, sf)
    keyed = c.select(codes.value_digest(F.lit("E"), F.col("email"), KEY).alias("entry"))
    careless = c.where("id % 9 = 0").select(F.sha2("email", 256).alias("entry")).unionByName(c.where("id % 11 = 0").select(F.col("email").alias("entry")))
    return analytics.linkage(c.select(F.col("email").alias("value")), keyed.unionByName(careless))


LINKAGE_SQL = f"select count(*) as attempts, count(*) filter (id % 9 = 0 or id % 11 = 0) as successes from ({CARDS}) c"


def recall(spark, sf):
    """Share of telephones and e-mails that can't be read in the coded cards."""
    t = _coded(spark, sf)
    sample = t.select(F.explode(F.array("pf", "email")).alias("value"), F.col("masked").alias("outgoing"))
    return analytics.recall(sample)


def rep_rate(spark, sf):
    """Case forms of surnames in clients' lines that the engine replaces, by a dictionary that lacks two of the seven surnames."""
    c = cards(spark, sf).select("surname").distinct()
    known = c.where("surname not in ('Петров', 'Попов')").select(F.col("surname").alias("value"), F.lit("lastname").alias("kind"))
    all_forms = names.forms(c.select(F.col("surname").alias("value"), F.lit("lastname").alias("kind")), rules(spark))
    texts = all_forms.select(F.concat_ws("#", "value", "form").alias("doc_id"), F.concat(F.lit("клиент "), "form", F.lit("; тел")).alias("text"), "form", "ord")
    k = names.Knowledge(exact=known.select("value"), forms=names.layer_bases(names.forms(known, rules(spark))))
    done = engine.protect(texts.select("doc_id", "text"), KEY, k).texts.join(texts.select("doc_id", "form", "ord"), "doc_id")
    return analytics.rep_rate(done.select("ord", (~analytics.present(F.col("form"), F.col("masked"))).alias("masked")))


REP_SQL = f"""
with s as (select distinct surname from ({CARDS}) c), f as (select surname, 0 as ord from s union all select surname, unnest([1, 2, 3, 4]) from s)
select count(*) as forms, avg(case when surname in ('Петров', 'Попов') then 0 else 1 end) as rep_rate, count(*) filter (surname in ('Петров', 'Попов') and ord = 0) as base_missed,
    count(*) filter (surname in ('Петров', 'Попов') and ord > 0) as declined_missed from f
"""


def false_blocks(spark, sf):
    """Clean texts that the gate would block after the engine has been over them."""
    done = engine.protect(table(spark, sf, "benchmark").groupBy("item_id").agg(F.min("text").alias("text")).withColumnRenamed("item_id", "doc_id"), KEY)
    return analytics.false_blocks(engine.verdict(done))


def reversibility(spark, sf):
    """Case forms of surnames that can be read in what went out: of every eighth card, whose text left by another way."""
    c = cards(spark, sf).select(F.col("id").alias("doc_id"), "surname", "email")
    forms_ = c.select("doc_id", F.explode(F.array(F.col("surname"), F.concat("surname", F.lit("у")), F.col("email"))).alias("form"))
    sent = c.select("doc_id", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("от "), "surname", F.lit("у"))).otherwise(F.concat(F.lit("от "), codes.code(F.lit("P"), F.lower("surname"), KEY))).alias("outgoing"))
    return analytics.reversibility(forms_, sent)


def glue(spark, sf):
    """Codes that answers showed as more than one person, and persons with several codes."""
    c = cards(spark, sf)
    seen = c.select(F.when(F.col("id") % 50 == 0, F.lit("zPX")).otherwise(F.concat(F.lit("zP"), F.col("id").cast("string"))).alias("code"), F.concat("surname", F.lit(" "), F.floor(F.col("id") / 70).cast("string")).alias("person"))
    return analytics.glue(seen)


GLUE_SQL = f"""
with s as (select case when id % 50 = 0 then 'zPX' else 'zP' || cast(id as varchar) end as code, surname || ' ' || cast(floor(id / 70) as bigint) as person from ({CARDS}) c)
select (select count(distinct code) from s) as codes, (select count(*) from (select code from s group by 1 having count(distinct person) > 1) a) as glued, (select count(*) from (select person from s group by 1 having count(distinct code) > 1) b) as split
"""


def ph_consistency(spark, sf):
    """Share of telephones with one code however they are spelled."""
    c = cards(spark, sf)
    t = c.select("phone", F.explode(F.array(F.concat(F.lit("тел "), "phone_a"), F.concat(F.lit("тел "), "phone_b"))).alias("text"))
    coded = tokenise.tokenise(t, KEY)
    return analytics.consistency(coded.select(F.col("phone").alias("value"), F.regexp_extract("masked", "zT[A-Z2-7]{8}", 0).alias("code")))


def false_activity(spark, sf):
    """Texts of the benchmark, which hold no personal data: none is changed."""
    t = tokenise.tokenise(table(spark, sf, "benchmark").select("item_id", "text"), KEY)
    return t.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("masked") != F.col("text")).alias("changed"))


def metric_verdicts(spark, sf):
    """Metrics against their bars."""
    m = table(spark, sf, "region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("name"), (F.col("r_regionkey") / 4.0).alias("value"), F.when(F.col("r_regionkey") % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5)).alias("bar"))
    return analytics.verdicts(m).select("name", "passed")


VERDICTS_SQL = "select 'm' || cast(r_regionkey as varchar) as name, case when r_regionkey % 2 = 0 then r_regionkey <= 0 else r_regionkey / 4.0 >= 0.5 end as passed from region"


def sufficiency(spark, sf):
    """Collision odds of codes for as many values as each nation has customers, times a thousand."""
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg((F.count(F.lit(1)) * 1000.0).alias("n"))
    s = analytics.sufficiency(F.col("n"), 8)
    return n.select("c_nationkey", F.round(s["collision"] * 1e9, 3).alias("collision_e9"), F.round(s["accidental"] * 1e12, 3).alias("accidental_e12"), s["capacity"].cast("long").alias("capacity"))


SUFFICIENCY_SQL = """
select c_nationkey, round((1 - exp(-n * n / (2 * power(32.0, 8)))) * 1e9, 3) as collision_e9, round(n / power(32.0, 8) * 1e12, 3) as accidental_e12, floor(sqrt(-2 * power(32.0, 8) * ln(0.999)))::bigint as capacity
from (select c_nationkey, count(*) * 1000.0::double as n from customer group by 1) q
"""


def code_price(spark, sf):
    """Characters that each of five surfaces costs against the raw value."""
    c = cards(spark, sf).select("email", codes.code(F.lit("E"), F.col("email"), KEY).alias("code"))
    return analytics.code_price(c, F.col("code"), F.col("email"))


PRICE_SQL = f"""
with s as (select sum(length(email))::bigint as raw, count(*) as n from ({CARDS}) x),
f as (select unnest(['raw', 'compact', 'framed', 'brackets', 'bare']) as format, unnest([raw, n * 10, n * 18, n * 16, n * 14]) as cost, raw from s)
select format, cost, round(cost / raw, 6) as ratio from f
"""


def cache_rate(spark, sf):
    e = table(spark, sf, "events")
    return analytics.cache_rate(e.select(F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("hit"), F.when(F.col("event_id") % 3 == 1, F.col("user_id")).alias("miss")))


CACHE_SQL = "select sum(user_id) filter (event_id % 3 = 0)::bigint as hits, sum(user_id) filter (event_id % 3 = 1)::bigint as misses, sum(user_id) filter (event_id % 3 = 0) / sum(user_id) filter (event_id % 3 in (0, 1)) as rate from events"


def pii_share(spark, sf):
    """Clean and dirty requests by all rules, their volume, and segments that have both; a third of the requests is a greeting."""
    text = f"case when id % 3 = 0 then 'добрый день' else {CUT_TEXT} end"
    docs = tokenise.with_spans(cards(spark, sf, f"segment || cast(id % 40 as string) as source, {text} as text"))
    return analytics.pii_share(docs.select(F.col("source").alias("session_id"), F.length("text").cast("long").alias("volume"), F.size("spans").alias("findings")))


SHARE_SQL = f"""
with d as (select segment || cast(id % 40 as varchar) as source, id % 3 <> 0 as dirty, length(case when id % 3 = 0 then 'добрый день' else {CUT_TEXT.replace('as string', 'as varchar')} end) as v from ({CARDS}) c),
s as (select source, count(*) as n, count(*) filter (dirty) as d, sum(v) as v, coalesce(sum(v) filter (dirty), 0) as dv from d group by source)
select sum(n)::bigint as requests, sum(d)::bigint as dirty, sum(v)::bigint as volume, sum(dv)::bigint as dirty_volume, count(*) filter (d > 0 and d < n) as mixed_sessions from s
"""


def replay_report(spark, sf):
    """What a replay of cards found by class, and what is left in every sixth text, which went out as it came."""
    c = cards(spark, sf, f"id, {CARD_TEXT} as text")
    t = tokenise.tokenise(c, KEY).withColumn("outgoing", F.when(F.col("id") % 6 == 0, F.col("text")).otherwise(F.col("masked")))
    left = t.select("id", F.explode(F.transform(gate.unmasked(F.col("outgoing")), lambda s: s["cls"])).alias("cls"), F.lit(0).alias("findings"), F.lit(1).alias("residual"))
    found = t.select("id", F.explode("spans.cls").alias("cls"), F.lit(1).alias("findings"), F.lit(0).alias("residual"))
    return analytics.replay_report(found.unionByName(left).withColumn("run", F.col("id") % 2))


REPLAY_SQL = f"""
with f as (select id % 2 as run, unnest(['T', 'E', 'D', 'C']) as cls, case when id % 6 = 0 then 1 else 0 end as r from ({CARDS}) c)
select run, cls, count(*) as findings, sum(r)::bigint as residual, sum(r) = 0 as clean from f group by grouping sets ((run, cls), (run))
"""


def merged_pieces(spark, sf):
    """Pieces of words that touch become one; made from line numbers."""
    p = table(spark, sf, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    return analytics.merged_pieces(p.where("l_linenumber != 3").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.col("l_linenumber").cast("string").alias("label")))


PIECES_SQL = """
with p as (select distinct l_orderkey as doc_id, l_linenumber as s from lineitem where l_linenumber <> 3), g as (select *, s - row_number() over (partition by doc_id order by s) as k from p)
select doc_id, min(s) as start, max(s) + 1 as "end", cast(min(s) as varchar) as label from g group by doc_id, k
"""


def health(spark, sf):
    """One row of what the engine holds: codes by class, and whether the registry may be used."""
    c = cards(spark, sf)
    row = lambda cls, column: coded(c, cls, column, "token").select("token", F.lit(cls).alias("cls"), F.col(column).alias("value"), F.col(column).alias("identity"), F.lit(None).cast("string").alias("source"))
    reg = row("T", "phone").unionByName(row("E", "email").where("length(value) % 2 = 0"))
    count = registry.counters(reg).where("kind = 'class'").groupBy().pivot("name", ["T", "E", "P"]).agg(F.sum("n"))
    return count.join(registry.inventory(reg).select("codes", "usable"), F.lit(True)).select(F.coalesce("T", F.lit(0)).alias("telephones"), F.coalesce("E", F.lit(0)).alias("emails"), F.coalesce("P", F.lit(0)).alias("persons"), "codes", "usable")


HEALTH_SQL = f"select count(*) as telephones, count(*) filter (length(email) % 2 = 0) as emails, 0 as persons, count(*) + count(*) filter (length(email) % 2 = 0) as codes, true as usable from ({CARDS}) c"


def ground_truth(spark, sf):
    """Clients per manager, and how a model's answers score against them: it is one off for every second name."""
    truth = cards(spark, sf).groupBy(F.concat_ws(" ", "given", "surname").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    said = F.concat(F.lit("У 1 менеджера клиентов: "), F.when(F.length("name") % 2 == 0, F.col("n")).otherwise(F.col("n") + 1).cast("string"))
    return analytics.scored_answers(truth, truth.select("name", said.alias("answer")))


TRUTH_SQL = f"""
with t as (select given || ' ' || surname as name, count(*) as n from ({CARDS}) c group by 1)
select name, n, case when length(name) % 2 = 0 then n else n + 1 end as said, length(name) % 2 = 0 as "right" from t
"""

QUERIES = [
    ("k_anonymity", k_anonymity, K_SQL),
    ("direct_lookup", direct_lookup, DIRECT_SQL),
    ("dictionary_linkage", dictionary_linkage, LINKAGE_SQL),
    ("recall", recall, f"select count(*) * 2 as \"values\", 1.0 as recall from ({CARDS}) c"),
    ("rep_rate", rep_rate, REP_SQL),
    ("false_blocks", false_blocks, "select count(distinct item_id) as texts, 0 as blocked from benchmark"),
    ("reversibility", reversibility, f"select count(*) * 3 as forms, count(*) filter (id % 8 = 0) as readable from ({CARDS}) c"),
    ("glue", glue, GLUE_SQL),
    ("replay_report", replay_report, REPLAY_SQL),
    ("ph_consistency", ph_consistency, f"select count(*) as \"values\", 1.0 as ph_consistency from ({CARDS}) c"),
    ("false_activity", false_activity, "select count(*) as texts, 0 as changed from benchmark"),
    ("metric_verdicts", metric_verdicts, VERDICTS_SQL),
    ("sufficiency", sufficiency, SUFFICIENCY_SQL),
    ("code_price", code_price, PRICE_SQL),
    ("cache_rate", cache_rate, CACHE_SQL),
    ("pii_share", pii_share, SHARE_SQL),
    ("merged_pieces", merged_pieces, PIECES_SQL),
    ("health", health, HEALTH_SQL),
    ("ground_truth", ground_truth, TRUTH_SQL),
]
