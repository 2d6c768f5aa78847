"""Queries on the registry, the dictionary and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import arrow, codes, normalize
from maskwright.functions.scan import Vocabulary
from maskwright.operators import dictionary, names, registry, training
from maskwright.session import settled, table

from .cards import CARDS, KEY, card_texts, cards, code_sql, coded, digest_sql, rules


def registry_assign(spark, sf):
    values = cards(spark, sf).select(F.lit("E").alias("cls"), F.col("email").alias("identity"), F.col("id").alias("first_seen"))
    return registry.assign(values, KEY).select("identity", "token", "salt")


def registry_collision_walk(spark, sf):
    """Codes of three letters for all cards, of more once those run short: collisions are sure, the walk resolves them, and whoever comes first keeps the first choice."""
    values = cards(spark, sf).select(F.lit("E").alias("cls"), F.col("email").alias("identity"), F.col("id").alias("first_seen"))
    done = registry.assign(values, KEY, length=3, salts=640, longest=codes.LENGTH)
    return done.agg(F.count(F.lit(1)).alias("identities"), F.count_distinct("token").alias("tokens"), F.count_if(F.col("salt") == 0).alias("first_choices"))


def legacy_rows(spark, sf):
    """A registry whose rows have no identity: a row is of whom its value matches; for any other its code is taken."""
    c = cards(spark, sf)
    code = codes.code(F.lit("E"), F.col("email"), KEY)
    held = c.select(code.alias("token"), F.lit(None).cast("string").alias("identity"), F.when(F.col("id") % 2 == 0, F.upper("email")).otherwise(F.lit("other@example.ru")).alias("value"))
    values = c.select(F.lit("E").alias("cls"), F.col("email").alias("identity"), F.col("id").alias("first_seen"))
    return registry.assign(values, KEY, held).select("identity", "token", "salt")


LEGACY_SQL = f"select email as identity, case when id % 2 = 0 then {code_sql('E', 'email')} else {code_sql('E', 'email', " || '#1'")} end as token, case when id % 2 = 0 then 0 else 1 end as salt from ({CARDS}) c"


def collision_first_round(spark, sf):
    """Who keeps the first-choice code of three letters: the first seen of all that want it."""
    values = cards(spark, sf).select(F.lit("T").alias("cls"), F.col("phone").alias("identity"), F.col("id").alias("first_seen"))
    return registry.first_choices(values, KEY, length=3).select("identity", "token")


def _rows(spark, sf, where: str, value: str, days: int, known=None):
    """Registry rows of some cards; their codes are those that ``known`` holds for them or leaves free."""
    c = coded(cards(spark, sf).where(where).withColumn("who", F.concat(F.lower("surname"), F.lit(" "), F.col("id").cast("string"))), "P", "who", "token", known)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600 + days * 86400)
    return c.select(
        "token", F.lit("P").alias("cls"), F.expr(value).alias("value"), F.col("who").alias("identity"),
        F.array("surname").alias("forms"), at.alias("created_at"), at.alias("last_used_at"), F.lit(None).cast("string").alias("source"),
    )


def registry_upsert(spark, sf):
    """Two thirds of all cards meet another two thirds: a first value stays, later spellings are added, last use moves on, new codes come in."""
    old = _rows(spark, sf, "id % 3 <> 0", "surname", 0)
    new = _rows(spark, sf, "id % 3 <> 1", "upper(surname)", 5, old).withColumn("forms", F.array(F.upper("identity"), F.col("identity")))
    done = registry.upsert(old, new)
    return done.select("identity", "value", F.array_join("forms", ",").alias("forms"), F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("last_used_at").alias("used"))


UPSERT_SQL = f"""
with c as (select *, lower(surname) || ' ' || cast(id as varchar) as who, 1700000000 + id * 3600 as moment from ({CARDS}) x)
select who as identity, case when id % 3 = 0 then upper(surname) else surname end as value,
    case id % 3 when 0 then upper(who) || ',' || who when 1 then surname else surname || ',' || upper(who) || ',' || who end as forms,
    case when id % 3 = 0 then moment + 5 * 86400 else moment end as created, case when id % 3 = 1 then moment else moment + 5 * 86400 end as used
from c
"""


def registry_purge(spark, sf):
    """What a registry of order customers keeps 90 days after the last order."""
    o = table(spark, sf, "orders")
    uses = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_used_at"))
    now = o.agg(F.max("o_orderdate").alias("now"))
    return registry.purged(uses.crossJoin(F.broadcast(now)), F.col("now")).select("o_custkey")


def registry_touch_and_mark(spark, sf):
    """Use and provenance noted on some rows."""
    reg = cards(spark, sf).select(F.col("id").cast("string").alias("token"), F.timestamp_seconds(F.lit(0)).alias("last_used_at"), F.when(F.col("id") % 4 == 0, F.lit("crm")).alias("source"))
    hit = reg.where("cast(token as bigint) % 2 = 0")
    done = registry.marked(registry.touched(reg, hit, F.timestamp_seconds(F.lit(100))), hit, "incident")
    return done.select("token", F.unix_timestamp("last_used_at").alias("used"), "source")


TOUCH_SQL = "select cast(c_custkey as varchar) as token, case when c_custkey % 2 = 0 then 100 else 0 end as used, case when c_custkey % 4 = 0 then 'crm' when c_custkey % 2 = 0 then 'incident' end as source from customer"


def integrity_scan(spark, sf):
    """Codes with several values: order customers as codes, their nations' ends as values."""
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 97).cast("string").alias("token"), F.col("c_mktsegment").alias("value"), F.col("c_nationkey").cast("string").alias("identity"))
    return registry.integrity(c)


INTEGRITY_SQL = """
select cast(c_custkey % 97 as varchar) as token, count(*) as records, count(distinct c_mktsegment) as "values", count(distinct c_nationkey) as persons
from customer group by 1 having count(*) > 1 or count(distinct c_mktsegment) > 1 or count(distinct c_nationkey) > 1
"""


def encrypted_values(spark, sf):
    """Values come back whole from authenticated encryption."""
    k = KEY[:32]
    c = cards(spark, sf).select("id", "email", registry.sealed(F.col("email"), k).alias("s"))
    return c.select("id", registry.opened(F.col("s"), k).alias("email"), (F.length("s") > F.length("email")).alias("sealed"))


def restore_allowed_only(spark, sf):
    """Texts with a code twice and another once: the n-th occurrence takes the n-th form, codes not allowed stay.

    Codes are the registry's, one a person; a telephone that is not restored stands as its first choice, whoever else has that."""
    from maskwright.operators import detect

    c = coded(card_texts(spark, sf, "*").select("id", "surname", "phone", F.concat(F.lower("surname"), F.col("id").cast("string")).alias("who")), "P", "who", "t")
    c = settled(coded(c, "T", "phone", "o"))
    shown = F.when(F.col("id") % 2 == 0, F.col("o")).otherwise(codes.code(F.lit("T"), F.col("phone"), KEY))
    text = F.concat_ws(" ", F.lit("К"), "t", F.lit("и"), "t", F.lit("тел"), shown, F.lit("и"), "t")
    texts = c.select(F.col("id").alias("doc_id"), text.alias("text"))
    texts = settled(texts.withColumn("spans", detect.code_spans(F.col("text"))))
    none = F.lit(None).cast("string")
    reg = c.select(F.col("t").alias("token"), F.array(F.concat("surname", F.lit("а")), F.col("surname")).alias("forms"), F.lower("surname").alias("identity"), F.col("surname").alias("value"))
    reg = reg.unionByName(c.select(F.col("o").alias("token"), F.array(F.lit("79")).alias("forms"), none.alias("identity"), F.lit("79").alias("value")))
    allowed = c.select(F.col("id").alias("doc_id"), F.col("t").alias("token")).unionByName(c.where("id % 2 = 0").select(F.col("id").alias("doc_id"), F.col("o").alias("token")))
    return registry.restore(texts, reg, allowed)


RESTORE_SQL = f"""
select id as doc_id, 'К ' || surname || 'а и ' || surname || ' тел ' || case when id % 2 = 0 then '79' else {code_sql('T', 'phone')} end || ' и ' || surname as restored, case when id % 2 = 0 then 4 else 3 end as replaced
from ({CARDS}) c
"""


def _words(spark, sf, name: str, column: str):
    return table(spark, sf, name).select(F.explode(F.split(column, " ")).alias("word")).distinct()


def known_numbers(spark, sf):
    """Number runs of documents that are client numbers of a dictionary, made from their own ends."""
    from maskwright.operators import detect

    docs = table(spark, sf, "documents").where(F.col("text").rlike("[0-9]{7}"))
    runs = docs.select("doc_id", F.explode(detect.number_runs(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.raw")
    values = runs.where("doc_id % 2 = 0").select(F.lit("C").alias("cls"), F.col("raw").alias("value"))
    found = dictionary.known_numbers(runs, dictionary.keyed(values, KEY), KEY)
    return found.groupBy("doc_id", "raw", "cls").agg(F.count(F.lit(1)).alias("n"))


NUMBERS_SQL = """
with r as (select doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) between 7 and 12)) as raw from documents)
select doc_id, raw, 'C' as cls, count(*) as n from r where ltrim(raw, '0') in (select ltrim(raw, '0') from r where doc_id % 2 = 0) group by 1, 2
"""


def dictionary_digests(spark, sf):
    c = cards(spark, sf)
    values = c.select(F.lit("T").alias("cls"), F.col("phone_a").alias("value")).unionByName(c.select(F.lit("E").alias("cls"), F.upper("email").alias("value"))).unionByName(c.where("id < 10").select(F.lit("E").alias("cls"), F.lit("no mail").alias("value")))
    return dictionary.keyed(values, KEY)


DIGESTS_SQL = f"select 'T' as cls, {digest_sql('T', 'phone')} as digest from ({CARDS}) c union select 'E', {digest_sql('E', 'email')} from ({CARDS}) c"


def dictionary_lookup(spark, sf):
    """Customers' names among the words of every second customer."""
    c = cards(spark, sf)
    digests = dictionary.keyed(c.where("id % 2 = 0").select(F.lit("E").alias("cls"), F.col("email").alias("value")), KEY)
    asked = c.select("id", F.lit("E").alias("cls"), codes.value_digest(F.lit("E"), F.col("email"), KEY).alias("digest"))
    return dictionary.lookup(asked, digests).select("id")


def form_index(spark, sf):
    """Remainders of customer keys as forms of segments; those of one segment only."""
    p = table(spark, sf, "customer").select((F.col("c_custkey") % F.greatest(F.lit(60), F.col("c_custkey") / 3).cast("long")).alias("form"), F.col("c_mktsegment").alias("base"))
    return dictionary.unambiguous(p)


def resolve_identity(spark, sf):
    """The base of a known form goes before the digest itself."""
    c = cards(spark, sf).select(F.lit("P").alias("cls"), F.col("id").cast("string").alias("digest"))
    forms = c.where("cast(digest as bigint) % 3 = 0").select("cls", F.col("digest").alias("form"), F.lit("base").alias("base"))
    return dictionary.resolve(c, forms, c.where("cast(digest as bigint) % 2 = 0")).select("digest", "identity")


RESOLVE_SQL = "select cast(c_custkey as varchar) as digest, case when c_custkey % 3 = 0 then 'pd:base' when c_custkey % 2 = 0 then 'pd:' || cast(c_custkey as varchar) end as identity from customer"


def _parts(spark, sf, where: str):
    return table(spark, sf, "part").where(where).select(F.lit("P").alias("cls"), F.col("p_partkey").alias("digest"))


def dictionary_add(spark, sf):
    """Parts added to a dictionary of parts, with forms: only of new ones, none that is a value or leads elsewhere."""
    digests, new = _parts(spark, sf, "p_partkey % 2 = 0"), _parts(spark, sf, "p_partkey % 3 = 0")
    forms = digests.select("cls", (F.col("digest") + 1_000_000).alias("form"), F.col("digest").alias("base"))
    new_forms = new.select("cls", F.when(F.col("digest") % 2 == 0, F.col("digest") + 1_000_000).when(F.col("digest") % 5 == 0, F.col("digest") + 1).otherwise(F.col("digest") + 2_000_000).alias("form"), F.col("digest").alias("base"))
    d, f = dictionary.add(digests, forms, new, new_forms)
    return d.select(F.lit("digest").alias("what"), F.col("digest").alias("key"), F.lit(None).cast("long").alias("base")).unionByName(f.select(F.lit("form").alias("what"), F.col("form").alias("key"), "base"))


ADD_SQL = """
select 'digest' as what, p_partkey as key, null::bigint as base from part where p_partkey % 2 = 0 or p_partkey % 3 = 0
union all select 'form', p_partkey + 1000000, p_partkey from part where p_partkey % 2 = 0
union all select 'form', case when p_partkey % 5 = 0 then p_partkey + 1 else p_partkey + 2000000 end, p_partkey from part
    where p_partkey % 2 <> 0 and p_partkey % 3 = 0 and (p_partkey % 5 <> 0 or p_partkey + 1 not in (select p_partkey from part))
"""


def dictionary_remove(spark, sf):
    """Values removed with their forms, and forms equal to them."""
    digests = _parts(spark, sf, "true")
    forms = digests.select("cls", (F.col("digest") + 10).alias("form"), F.col("digest").alias("base"))
    d, f = dictionary.remove(digests, forms, _parts(spark, sf, "p_partkey % 7 = 0"))
    return d.select(F.lit("digest").alias("what"), F.col("digest").alias("key")).unionByName(f.select(F.lit("form").alias("what"), F.col("form").alias("key")))


REMOVE_SQL = """
select 'digest' as what, p_partkey as key from part where p_partkey % 7 <> 0
union all select 'form', p_partkey + 10 from part where p_partkey % 7 <> 0 and not ((p_partkey + 10) % 7 = 0 and p_partkey + 10 in (select p_partkey from part))
"""


def layer_difference(spark, sf):
    """Words of part names that no type has."""
    own = _words(spark, sf, "part", "p_name").select(F.lit("P").alias("cls"), F.col("word").alias("value"))
    layer = _words(spark, sf, "part", "p_type").select(F.lit("P").alias("cls"), F.col("word").alias("value"))
    return dictionary.not_covered(own, layer)


LAYER_SQL = """
select distinct 'P' as cls, w as value from (select unnest(string_split(p_name, ' ')) as w from part) a
where lower(w) not in (select lower(unnest(string_split(p_type, ' '))) from part)
"""


def name_sources(spark, sf):
    """What each source of names adds."""
    c = cards(spark, sf)
    return dictionary.collected({"surnames": c.select(F.col("surname").alias("value")), "given": c.select(F.col("given").alias("value")), "some": c.where("id < 3").select(F.col("surname").alias("value"))})[1]


SOURCES_SQL = f"""
with v as (select distinct 'surnames' as source, surname as value from ({CARDS}) c union select distinct 'given', given from ({CARDS}) c union select distinct 'some', surname from ({CARDS}) c where id < 3)
select source, count(*) as "values", count(*) filter (n = 1) as only_here from (select *, count(*) over (partition by value) as n from v) q group by source
"""


def combination_index(spark, sf):
    c = cards(spark, sf).select(F.array(F.col("surname"), F.col("given"), F.concat(F.lit("client"), F.col("id").cast("string"))).alias("parts"))
    return dictionary.combos(c, KEY).agg(F.count(F.lit(1)).alias("combos"), F.min("digest").alias("least"), F.max("digest").alias("most"))


def _pair(a, b):
    return f"least({a}, {b}) || '|' || greatest({a}, {b})"


COMBOS_SQL = f"""
with n as (select lower(surname) as a, replace(lower(given), 'ё', 'е') as b, 'client' || cast(id as varchar) as c from ({CARDS}) x),
p as (select {_pair('a', 'b')} as s from n union select {_pair('a', 'c')} from n union select {_pair('b', 'c')} from n union select array_to_string(list_sort([a, b, c]), '|') from n)
select count(*) as combos, min(d) as least, max(d) as most from (select distinct {digest_sql('P', 's')} as d from p) q
"""


def family_roots(spark, sf):
    """Forms followed to their roots: chains of part keys, with forks where a key has two bases."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("form"))
    edges = p.where("form % 8 <> 0").select("form", (F.col("form") - 1).alias("base")).unionByName(p.where("form % 40 = 5").select("form", (F.col("form") - 2).alias("base")))
    return dictionary.roots(edges)


ROOTS_SQL = """
with recursive e as (select p_partkey as form, p_partkey - 1 as base from part where p_partkey % 8 <> 0 union select p_partkey, p_partkey - 2 from part where p_partkey % 40 = 5),
u as (select form, min(base) as base from e group by form having count(distinct base) = 1),
v as (select form as v from e union select base from e),
r as (select v as form, v as top from v union all select r.form, u.base from r join u on u.form = r.top)
select form, min(top) as root from r group by form
"""


def noise_report(spark, sf):
    """Words of part types among a dictionary of words of part names."""
    words = table(spark, sf, "part").select(F.col("p_brand").alias("category"), F.explode(F.split("p_type", " ")).alias("word"))
    digests = dictionary.keyed(_words(spark, sf, "part", "p_name").select(F.lit("P").alias("cls"), F.col("word").alias("value")), KEY)
    return dictionary.noise(words, digests, KEY).select("category", "checked", "present")


NOISE_SQL = """
with w as (select distinct p_brand as category, unnest(string_split(p_type, ' ')) as word from part), d as (select distinct lower(unnest(string_split(p_name, ' '))) as word from part)
select category, count(*) as checked, count(*) filter (lower(word) in (select word from d)) as present from w group by category
"""


def weekly_cap(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return dictionary.capped(s, [F.desc("s_acctbal"), F.asc("s_suppkey")], ["s_suppkey"], 5).select("s_suppkey", "verdict")


def first_values(spark, sf):
    """Repeats of a value in other case are dropped; the first stays."""
    c = cards(spark, sf)
    rows = c.select(F.lit("P").alias("cls"), F.when(F.col("id") % 2 == 0, F.upper("surname")).otherwise(F.col("surname")).alias("value"), F.col("id").alias("ord"))
    return dictionary.first_values(rows)


FIRST_SQL = f"select 'P' as cls, case when id % 2 = 0 then upper(surname) else surname end as value, id as ord from ({CARDS}) c qualify row_number() over (partition by lower(surname) order by id) = 1"


def classify_fields(spark, sf):
    c = cards(spark, sf)
    value = F.when(F.col("id") % 5 == 0, F.col("phone_a")).when(F.col("id") % 5 == 1, F.upper("email")).when(F.col("id") % 5 == 2, F.concat("surname", F.lit("  "), "given")).when(F.col("id") % 5 == 3, F.lit("N/A")).otherwise(F.lit("  "))
    f = dictionary.classify_field(value)
    return c.select("id", f["cls"].alias("cls"), f["cleaned"].alias("cleaned"), f["reason"].alias("reason"))


CLASSIFY_SQL = f"""
select id, case id % 5 when 0 then 'T' when 1 then 'E' when 2 then 'P' end as cls, case id % 5 when 0 then phone when 1 then email when 2 then surname || ' ' || given when 3 then 'N/A' else '' end as cleaned,
    case id % 5 when 0 then 'phone' when 1 then 'email' when 2 then 'name' when 3 then 'placeholder' else 'empty' end as reason
from ({CARDS}) c
"""

def declined_forms(spark, sf):
    c = cards(spark, sf).select(F.col("surname").alias("value"), F.lit("lastname").alias("kind"))
    return names.forms(c, rules(spark))


DECLINED_SQL = f"""
with s as (select distinct surname as value from ({CARDS}) c),
m as (select value, unnest(['а', 'у', 'ым', 'е']) as e, unnest([1, 2, 4, 5]) as ord from s where regexp_matches(value, '(ов|ев|ин)$'))
select value, value as form, 0 as ord from s union all select value, value || e, ord from m
"""


def layer_bases(spark, sf):
    c = cards(spark, sf).select(F.col("surname").alias("value"), F.lit("lastname").alias("kind"))
    return names.layer_bases(names.forms(c, rules(spark)))


LAYER_BASES_SQL = f"select lower(form) as form, min(lower(value)) as base from ({DECLINED_SQL}) q group by 1 having count(distinct value) = 1"


def transliterated(spark, sf):
    """Latin spellings that some known surname has."""
    latin = F.element_at(F.array(*(F.lit(x) for x in ("Ivanov", "Petrov", "Popov", "Smirnov", "Brown", "Lebedev", "Green"))), (F.col("id") % 7 + 1).cast("int"))
    c = cards(spark, sf)
    return names.transliterated(c.select(latin.alias("value")), c.select(F.col("surname").alias("value")))


def name_decisions(spark, sf):
    """Names in client lines by dictionary form, by layer, and not at all: inside an address, or a word of the trade."""
    c = cards(spark, sf).select("id", "surname", "given")
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("клиент "), "surname", F.lit("а; тел"))).when(F.col("id") % 4 == 1, F.concat(F.lit("клиент "), "given", F.lit("; тел"))).when(F.col("id") % 4 == 2, F.concat(F.lit("ул. "), "surname", F.lit("а; тел"))).otherwise(F.lit("клиент Абонемент; тел"))
    words = Vocabulary.of(terms=["абонемент", "тел"], values="клиент")
    asks = c.select(F.col("id").alias("doc_id"), F.explode(arrow.scanned(text, words)["asks"]).alias("a")).select("doc_id", "a.*")
    surnames = c.select(F.col("surname").alias("value"), F.lit("lastname").alias("kind")).distinct()
    known = names.Knowledge(exact=surnames.select("value"), forms=names.layer_bases(names.forms(surnames, rules(spark))), layer=c.select(F.col("given").alias("value")).distinct())
    return names.decide(asks, known).select("doc_id", "start", "raw", "identity")


DECISIONS_SQL = f"""
select id as doc_id, 7 as start, case when id % 4 = 0 then surname || 'а' else given end as raw, case when id % 4 = 0 then lower(surname) else replace(lower(given), 'ё', 'е') end as identity
from ({CARDS}) c where id % 4 in (0, 1)
"""


def evidence(spark, sf):
    """Values in capitals: names by two signs, a known one by the dictionary, and business phrases that only look alike."""
    c = cards(spark, sf)
    value = F.when(F.col("id") % 3 == 0, F.upper(F.concat_ws(" ", "surname", "given"))).when(F.col("id") % 3 == 1, F.concat(F.lit("БАЛАНС "), F.upper("segment"))).otherwise(F.concat(F.lit("ОПЛАТА "), F.upper("given")))
    common = spark.createDataFrame([("баланс", False, True), ("оплата", False, True)], "word string, is_name boolean, is_common boolean")
    morphology = common.unionByName(c.select(F.lower("segment").alias("word"), F.lit(False).alias("is_name"), F.lit(True).alias("is_common")).distinct())
    morphology = morphology.unionByName(c.select(normalize.identity_key(F.col("given")).alias("word"), F.lit(False).alias("is_name"), F.lit(False).alias("is_common")).distinct())
    return names.evidence(c.select(value.alias("value")).distinct(), c.where("given < 'О'").select(F.col("given").alias("value")).distinct(), morphology)


EVIDENCE_SQL = f"""
select distinct case id % 3 when 0 then upper(surname || ' ' || given) when 1 then 'БАЛАНС ' || upper(segment) else 'ОПЛАТА ' || upper(given) end as value,
    case id % 3 when 0 then true when 1 then false else given < 'О' end as admitted
from ({CARDS}) c
"""


def identity_cascade(spark, sf):
    """Where an identity comes from: a client's name, a form of one, the keyed dictionary, the open layer's base, or the spelling itself, which a keyed form may anchor."""
    c = cards(spark, sf)
    spelled = F.element_at(F.array(*(F.lit(x) for x in ("Иванов", "Иванову", "Петровым", "Сидорова", "Кузнецове", "Лебедев", "Попов"))), (F.col("id") % 7 + 1).cast("int"))
    words = c.select(spelled.alias("raw"), normalize.identity_key(spelled).alias("k"), normalize.name(spelled).alias("norm"), F.lit(True).alias("single")).distinct()
    one = lambda *v: spark.createDataFrame([(x, "lastname") for x in v], "value string, kind string")
    key = lambda *v: dictionary.keyed(one(*v).select(F.lit("P").alias("cls"), "value"), KEY)
    keyed_form = spark.createDataFrame([("P", "петровым", "петров")], "cls string, form string, base string").select("cls", codes.value_digest(F.lit("P"), F.col("form"), KEY).alias("form"), codes.value_digest(F.lit("P"), F.col("base"), KEY).alias("base"))
    k = names.Knowledge(
        exact=one("Иванов").select("value"), forms=names.layer_bases(names.forms(one("Иванов"), rules(spark))), digests=key("Петров", "Лебедева", "Сидоров"), form_digests=keyed_form,
        layer=one("Сидоров", "Кузнецов").select("value"), layer_forms=names.layer_bases(names.forms(one("Сидоров", "Кузнецов"), rules(spark))), rules=rules(spark), key=KEY,
    )
    return names.identities(words, k).select("raw", "identity", "source")


CASCADE_SQL = f"""
with d as (select *, {digest_sql('P', 'base')} as digest from (values ('петров'), ('сидоров'), ('лебедева')) t(base)),
w as (select distinct list_value('Иванов', 'Иванову', 'Петровым', 'Сидорова', 'Кузнецове', 'Лебедев', 'Попов')[c_custkey % 7 + 1] as raw from customer)
select raw, case raw when 'Иванов' then 'иванов' when 'Иванову' then 'иванов' when 'Петровым' then 'pd:' || (select digest from d where base = 'петров') when 'Сидорова' then 'pd:' || (select digest from d where base = 'сидоров')
    when 'Кузнецове' then 'кузнецов' when 'Лебедев' then 'pd:' || (select digest from d where base = 'лебедева') else 'попов' end as identity,
    case raw when 'Иванов' then 'exact' when 'Иванову' then 'form' when 'Петровым' then 'digest' when 'Сидорова' then 'layer_base' when 'Кузнецове' then 'layer_base' else 'surface' end as source
from w
"""


def dictionary_export(spark, sf):
    """Records to a keyed dictionary: values, and case forms that lead to their family, as digests."""
    c = cards(spark, sf)
    none = F.lit(None).cast("string")
    records = c.select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, F.concat("surname", F.lit("а"))).otherwise(F.col("surname")).alias("surname"), none.alias("name"), none.alias("patronymic"), F.col("phone_a").alias("phone"), none.alias("email"),
        none.alias("birth_date"), none.alias("address"), F.array().cast("array<struct<contact_type:string,contact:string>>").alias("contacts"),
    )
    digests, led = training.dictionary_of(records, rules(spark), KEY)
    return digests.select(F.lit("value").alias("what"), "cls", "digest", F.lit(None).cast("string").alias("base")).unionByName(led.select(F.lit("form").alias("what"), "cls", F.col("form").alias("digest"), "base"))


EXPORT_SQL = f"""
with s as (select distinct lower(surname) as base from ({CARDS}) c), m as (select base, base || unnest(['а', 'у', 'ым', 'е', 'ой']) as form from s)
select 'value' as what, 'P' as cls, {digest_sql('P', 'v')} as digest, null::varchar as base from (select distinct lower(case when id % 4 = 0 then surname || 'а' else surname end) as v from ({CARDS}) c) q
union all select 'value', 'T', {digest_sql('T', 'phone')}, null from ({CARDS}) c union all select 'value', 'C', {digest_sql('C', 'cast(id as varchar)')}, null from ({CARDS}) c
union all select 'form', 'P', {digest_sql('P', 'form')}, {digest_sql('P', 'base')} from m
"""


def registry_counters(spark, sf):
    """Codes of a registry by class and by source, and its state as a whole."""
    c = cards(spark, sf).select(F.col("id").cast("string").alias("token"), F.when(F.col("id") % 3 == 0, "P").otherwise("T").alias("cls"), F.when(F.col("id") % 2 == 0, "incident").alias("source"))
    return registry.counters(c)


COUNTERS_SQL = """
select 'class' as kind, case when c_custkey % 3 = 0 then 'P' else 'T' end as name, count(*) as n from customer group by 2
union all select 'source', case when c_custkey % 2 = 0 then 'incident' else '-' end, count(*) from customer group by 2
"""


def registry_inventory(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 977).cast("string").alias("token"), F.col("c_mktsegment").alias("value"), F.col("c_nationkey").cast("string").alias("identity"))
    return registry.inventory(c)


INVENTORY_SQL = """
with t as (select c_custkey % 977 as token, count(*) as r, count(distinct c_mktsegment) as v, count(distinct c_nationkey) as p from customer group by 1)
select count(*) as codes, sum(r)::bigint as records, count(*) filter (r > 1) as repeated, count(*) filter (v > 1) as conflicts, count(*) filter (p > 1) as glued, count(*) filter (r > 1 or v > 1 or p > 1) = 0 as usable from t
"""


def cache_validity(spark, sf):
    """Coded texts kept from before that may be used again: all their codes still stand for the same identities."""
    c = cards(spark, sf)
    tokens, before = F.array(F.col("id").cast("string"), (F.col("id") % 100).cast("string")), F.array("surname", F.concat(F.lit("n"), (F.col("id") % 100).cast("string")))
    cache = c.select(registry.cache_key(F.col("email"), F.lit("v1")).alias("cache_key"), tokens.alias("tokens"), registry.bindings_tag(tokens, before).alias("tag"), "id").where("id >= 100")
    now = c.select(F.col("id").cast("string").alias("token"), F.when(F.col("id") < 100, F.concat(F.lit("n"), F.col("id").cast("string"))).when(F.col("id") % 5 == 0, "other").otherwise(F.col("surname")).alias("identity"))
    now = now.unionByName(spark.createDataFrame([("0", "n0")], "token string, identity string"))
    return registry.still_valid(cache, now).select("id")


def cache_budget(spark, sf):
    """The coded texts used last, as many as fit."""
    c = table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("cache_key"), F.length("c_mktsegment").cast("long").alias("bytes"), F.timestamp_seconds(F.col("c_custkey") % 7).alias("last_used_at"))
    return registry.within_budget(c, 60, 400).select("cache_key")


BUDGET_SQL = """
with l as (select lpad(cast(c_custkey as varchar), 9, '0') as cache_key, length(c_mktsegment) as b, c_custkey % 7 as u from customer order by u desc, cache_key limit 60)
select cache_key from (select *, sum(b) over (order by u desc, cache_key) as t from l) q where t <= 400
"""


def identity_matches(spark, sf):
    """Whether stored values are of an identity: by canonical form, by a name's key, never by look alone."""
    c = cards(spark, sf)
    got = F.when(F.col("id") % 2 == 0, registry.matches_identity(F.lit("T"), F.col("phone_b"), F.col("phone"))).otherwise(registry.matches_identity(F.lit("P"), F.concat(F.lit("«"), F.col("given"), F.lit("»")), F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(normalize.identity_key(F.col("given")))))
    return c.select("id", got.alias("same"))


def noise_kinds(spark, sf):
    """What values are by shape, and why would-be names are noise; what the open layer has never is."""
    c = cards(spark, sf)
    value = F.element_at(F.array(F.col("surname"), F.concat("surname", F.lit(" 2")), F.lit("Я"), F.lit("Абонемент"), F.col("phone_a"), F.concat("surname", F.lit(" и его три друга")), F.col("email")), (F.col("id") % 7 + 1).cast("int"))
    words = Vocabulary.of(terms=["абонемент"])
    return c.select("id", dictionary.shape_class(value).alias("shape"), dictionary.noise_kind(value, F.col("id") % 2 == 0, names.is_own_word(value, words)).alias("noise"))


NOISE_KINDS_SQL = """
select c_custkey as id, case c_custkey % 7 when 4 then 'T' when 6 then 'E' else 'P' end as shape,
    case when c_custkey % 2 = 0 then null else case c_custkey % 7 when 1 then 'digits' when 2 then 'one_letter' when 3 then 'own_word' when 4 then 'digits' when 5 then 'sentence' when 6 then 'digits' end end as noise from customer
"""


QUERIES = [
    ("registry_assign", registry_assign, f"select email as identity, {code_sql('E', 'email')} as token, 0 as salt from ({CARDS}) c"),
    ("registry_collision_walk", registry_collision_walk, f"select count(*) as identities, count(*) as tokens, count(distinct {code_sql('E', 'email', length=3)}) as first_choices from ({CARDS}) c"),
    ("legacy_rows", legacy_rows, LEGACY_SQL),
    ("identity_cascade", identity_cascade, CASCADE_SQL),
    ("dictionary_export", dictionary_export, EXPORT_SQL),
    ("registry_counters", registry_counters, COUNTERS_SQL),
    ("registry_inventory", registry_inventory, INVENTORY_SQL),
    ("cache_validity", cache_validity, "select c_custkey as id from customer where c_custkey >= 100 and c_custkey % 5 <> 0"),
    ("cache_budget", cache_budget, BUDGET_SQL),
    ("identity_matches", identity_matches, "select c_custkey as id, c_custkey % 2 = 0 or c_custkey % 3 <> 0 as same from customer"),
    ("noise_kinds", noise_kinds, NOISE_KINDS_SQL),
    ("collision_first_round", collision_first_round, f"select phone as identity, {code_sql('T', 'phone', length=3)} as token from ({CARDS}) c qualify row_number() over (partition by {code_sql('T', 'phone', length=3)} order by id) = 1"),
    ("registry_upsert", registry_upsert, UPSERT_SQL),
    ("registry_purge", registry_purge, "select o_custkey from orders group by 1 having max(o_orderdate) >= (select max(o_orderdate) from orders) - interval 90 day"),
    ("registry_touch_and_mark", registry_touch_and_mark, TOUCH_SQL),
    ("integrity_scan", integrity_scan, INTEGRITY_SQL),
    ("encrypted_values", encrypted_values, f"select id, email, true as sealed from ({CARDS}) c"),
    ("restore_allowed_only", restore_allowed_only, RESTORE_SQL),
    ("known_numbers", known_numbers, NUMBERS_SQL),
    ("dictionary_digests", dictionary_digests, DIGESTS_SQL),
    ("dictionary_lookup", dictionary_lookup, f"select id from ({CARDS}) c where id % 2 = 0"),
    ("form_index", form_index, "select form, min(base) as base from (select c_custkey % greatest(60, c_custkey // 3) as form, c_mktsegment as base from customer) q group by form having count(distinct base) = 1"),
    ("resolve_identity", resolve_identity, RESOLVE_SQL),
    ("dictionary_add", dictionary_add, ADD_SQL),
    ("dictionary_remove", dictionary_remove, REMOVE_SQL),
    ("layer_difference", layer_difference, LAYER_SQL),
    ("name_sources", name_sources, SOURCES_SQL),
    ("combination_index", combination_index, COMBOS_SQL),
    ("family_roots", family_roots, ROOTS_SQL),
    ("noise_report", noise_report, NOISE_SQL),
    ("weekly_cap", weekly_cap, "select s_suppkey, case when row_number() over (order by s_acctbal desc, s_suppkey) <= 5 then 'accepted' else 'over_limit' end as verdict from supplier"),
    ("first_values", first_values, FIRST_SQL),
    ("classify_fields", classify_fields, CLASSIFY_SQL),
    ("declined_forms", declined_forms, DECLINED_SQL),
    ("layer_bases", layer_bases, LAYER_BASES_SQL),
    ("transliterated", transliterated, "select unnest(['Ivanov', 'Petrov', 'Popov', 'Smirnov', 'Lebedev']) as value"),
    ("name_decisions", name_decisions, DECISIONS_SQL),
    ("evidence", evidence, EVIDENCE_SQL),
]
