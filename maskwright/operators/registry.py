"""The registry of codes and values: assignment with collisions resolved, upsert, forms, expiry, integrity, restoring.

A registry is a table (token, cls, value, identity, forms, created_at, last_used_at, source).
Values are encrypted where it is stored (``sealed`` / ``opened``); equality never looks at ciphertexts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import arrow, codes, normalize
from maskwright.session import settled

FORMS, TTL_DAYS = 8, 90


def matches_identity(cls: Column, value: Column, identity: Column) -> Column:
    """Whether a stored value is of this identity: by its canonical form, or as a name by its key. Keyed identities match no readable value."""
    return F.coalesce((normalize.normalize(cls, value) == identity) | (cls == "P") & (normalize.identity_key(value) == identity), F.lit(False))


def _round(wanted: DataFrame, taken: DataFrame | None, token: Column, salt: int) -> DataFrame:
    """``wanted`` (cls, identity, first_seen) with the candidate ``token``, salt, and won: whether it is theirs.

    A candidate in ``taken`` (token, holder, held_value) is its holder's alone, of several holders' nobody's; of those that want a free one the first seen wins, ties by identity.
    """
    tried = wanted.withColumn("token", token).withColumn("salt", F.lit(salt))
    place = F.row_number().over(Window.partitionBy("token").orderBy("first_seen", "identity"))
    if taken is None:
        return tried.withColumn("won", place == 1)
    one = taken.groupBy("token").agg(F.collect_set(F.struct("holder", "held_value")).alias("held"))
    own = lambda h: (h["holder"] == F.col("identity")) | matches_identity(F.col("cls"), h["held_value"], F.col("identity"))
    judged = tried.join(one, "token", "left").withColumn("place", place)
    return judged.withColumn("won", F.when(F.col("held").isNull(), F.col("place") == 1).otherwise(F.coalesce(F.forall("held", own), F.lit(False)))).drop("held", "place")


def _wanted(values: DataFrame) -> DataFrame:
    return values.groupBy("cls", "identity").agg(F.min("first_seen").alias("first_seen"))


def first_choices(values: DataFrame, key: bytes, length: int = codes.LENGTH) -> DataFrame:
    """(cls, identity, token) of the identities of ``values`` (cls, identity, first_seen) that keep their first choice: one round of ``assign``, however many identities there are."""
    return _round(_wanted(values), None, codes.code(F.col("cls"), F.col("identity"), key, 0, length), 0).where("won").select("cls", "identity", "token")


#: Rounds whose codes are put together in one table, so that plans don't grow with the number of rounds.
JOINED = 8


def assign(values: DataFrame, key: bytes, registry: DataFrame | None = None, salts: int = codes.SALTS, length: int = codes.LENGTH, longest: int | None = None) -> DataFrame:
    """(cls, identity, token, salt) for the distinct identities of ``values`` (cls, identity, first_seen).

    Each round gives the identities still without a code their next candidate. A candidate
    that the registry holds for another identity is taken: a row without identity is held by whom its value
    matches, and by nobody else. Of several that want a free one, the first seen gets it (ties by identity).
    Rounds end when all have one: usually the first, as codes have 40 bits. Running out of candidates is an error.

    With ``longest`` codes shorter than that grow: once fewer than half the codes of a class are free at its length, those
    still without one go on with a letter more. So any number of identities gets codes, and a round leaves about half of them at most.
    """
    wanted = _wanted(values)
    held = None
    if registry is not None:
        value = F.col("value") if "value" in registry.columns else F.lit(None).cast("string")
        held = registry.select("token", F.col("identity").alias("holder"), value.alias("held_value"))
    none = F.lit(None).cast("string")
    done: list[DataFrame] = []
    grown: dict[str, int] = {}
    for salt in range(salts):
        if len(done) > JOINED:
            done = [settled(reduce(DataFrame.unionByName, done).repartition("token"))]
        taken = [*([held] if held is not None else []), *(d.select("token", F.col("identity").alias("holder"), none.alias("held_value")) for d in done)]
        code = lambda n: codes.code(F.col("cls"), F.col("identity"), key, salt, n)
        token = reduce(lambda c, x: F.when(F.col("cls") == x[0], code(x[1])).otherwise(c), sorted(grown.items()), code(length))
        judged = settled(_round(wanted, reduce(DataFrame.unionByName, taken) if taken else None, token, salt))
        done.append(judged.where("won").select("cls", "identity", "first_seen", "token", "salt"))
        wanted = judged.where("not won").select("cls", "identity", "first_seen")
        if wanted.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if longest is not None:
            full = reduce(DataFrame.unionByName, [*taken, done[-1].select("token", F.col("identity").alias("holder"), none.alias("held_value"))])
            size = F.length("token") - len(codes.PREFIX) - 1
            counts = full.groupBy(F.substring("token", len(codes.PREFIX) + 1, 1).alias("cls"), size.alias("size")).agg(F.count_distinct("token").alias("n")).collect()
            for r in counts:
                if r["size"] == grown.get(r["cls"], length) < longest and 2 * r["n"] > len(codes.ALPHABET) ** r["size"]:
                    grown[r["cls"]] = r["size"] + 1
    raise RuntimeError(f"no free code among {salts} candidates")


def upsert(registry: DataFrame, fresh: DataFrame) -> DataFrame:
    """The registry with ``fresh`` rows: a first value stays for ever, an identity fills a null one, last use moves on.

    A row meets one of its code only if they don't name different identities: two persons never become one. Codes come from ``assign``, which lets no two share one; ``integrity`` tells of any that do.
    """
    o, n = registry.alias("o"), fresh.alias("n")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    same = (F.col("o.token") == F.col("n.token")) & F.coalesce(F.col("o.identity") == F.col("n.identity"), F.lit(True))
    return o.join(n, same, "full_outer").select(
        pick("token"), pick("cls"), pick("value"), pick("identity"),
        merged_forms(F.col("o.forms"), F.col("n.forms")).alias("forms"),
        pick("created_at"), F.greatest("o.last_used_at", "n.last_used_at").alias("last_used_at"), pick("source"),
    )


def merged_forms(old: Column, new: Column) -> Column:
    """Observed spellings in order of arrival, trimmed, without repeats, at most FORMS."""
    empty = F.array().cast("array<string>")
    every = F.filter(F.transform(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)), lambda f: F.trim(f)), lambda f: f != "")
    return F.slice(F.array_distinct(every), 1, FORMS)


def touched(registry: DataFrame, used: DataFrame, at: Column) -> DataFrame:
    """Last use of the tokens in ``used`` moved to ``at``."""
    mark = used.select("token").distinct().withColumn("hit", F.lit(True))
    moved = F.when(F.col("hit"), F.greatest("last_used_at", at)).otherwise(F.col("last_used_at"))
    return registry.join(mark, "token", "left").withColumn("last_used_at", moved).drop("hit")


def purged(registry: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Rows used within the last ``days`` days; a filter that reaches the scan."""
    return registry.where(F.col("last_used_at") >= now - F.make_dt_interval(F.lit(days)))


def marked(registry: DataFrame, tokens: DataFrame, source: str) -> DataFrame:
    """``source`` noted on the rows of ``tokens`` that have none."""
    mark = tokens.select("token").distinct().withColumn("hit", F.lit(True))
    return registry.join(mark, "token", "left").withColumn("source", F.coalesce("source", F.when(F.col("hit"), F.lit(source)))).drop("hit")


def integrity(registry: DataFrame) -> DataFrame:
    """Per token: rows, values and identities, of those that have more than one of any: none should."""
    return registry.groupBy("token").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("value").alias("values"), F.count_distinct("identity").alias("persons")
    ).where((F.col("records") > 1) | (F.col("values") > 1) | (F.col("persons") > 1))


def sealed(value: Column, key: bytes) -> Column:
    """Authenticated encryption with a random start: equal values differ."""
    return F.aes_encrypt(value, F.lit(bytearray(key)), F.lit("GCM"))


def opened(sealed_value: Column, key: bytes) -> Column:
    return F.aes_decrypt(sealed_value, F.lit(bytearray(key)), F.lit("GCM")).cast("string")


def form_at(forms: Column, index: Column, identity: Column, value: Column) -> Column:
    """What the n-th occurrence (from 0) of a code is restored to: its n-th observed form, beyond
    those the form equal to the identity, else the readable identity, the value, the first form."""
    same = F.get(F.filter(forms, lambda f: F.lower(f) == F.lower(identity)), F.lit(0))
    readable = F.when(~identity.startswith("pd:"), identity)
    return F.coalesce(F.get(forms, index), same, readable, value, F.get(forms, F.lit(0)))


def restore(texts: DataFrame, registry: DataFrame, allowed: DataFrame, key: str = "doc_id", refused: DataFrame | None = None) -> DataFrame:
    """(key, restored, replaced): codes of ``texts`` (key, text, spans of codes) replaced by forms.

    Only codes that ``allowed`` (key, token) lists for the text are restored: the n-th occurrence of a
    code takes its n-th form. Codes that are ambiguous, unknown or not allowed stay, and so do those at the places ``refused`` (key, start).
    Codes meet the registry one row each, and only rows of codes that are asked for are looked through; the text waits on its own side until the spans come back.
    """
    met = matched(texts, registry, allowed, key)
    if refused is not None:
        met = met.join(refused.select(key, "start"), [key, "start"], "left_anti")
    put = F.struct("start", "end", "form")
    found = met.groupBy(key).agg(F.array_sort(F.collect_list(put)).alias("puts"))
    puts = F.coalesce("puts", F.array().cast("array<struct<start:int,end:int,form:string>>"))
    return texts.join(found, key, "left").select(key, arrow.spliced(F.col("text"), puts, F.transform(puts, lambda p: p["form"])).alias("restored"), F.size(puts).alias("replaced"))


def matched(texts: DataFrame, registry: DataFrame, allowed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, token, form, value) of the codes in ``texts`` that may be restored, each with what it is restored to."""
    each = texts.select(key, F.explode("spans").alias("s")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.norm").alias("token"))
    nth = Window.partitionBy(key, "token").orderBy("start")
    each = each.withColumn("n", F.row_number().over(nth) - 1).join(allowed.select(key, "token").distinct(), [key, "token"], "left_semi")
    asked = registry.join(allowed.select("token").distinct(), "token", "left_semi")
    known = asked.groupBy("token").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("value").alias("values"), F.count_distinct("identity").alias("persons"),
        F.first("forms").alias("forms"), F.first("identity").alias("identity"), F.first("value").alias("value"),
    ).where("records = 1 and values <= 1 and persons <= 1")
    met = each.join(known.select("token", "forms", "identity", "value"), "token")
    return met.select(key, "start", "end", "token", form_at(F.col("forms"), F.col("n"), F.col("identity"), F.col("value")).alias("form"), "value")


def counters(registry: DataFrame) -> DataFrame:
    """(kind, name, n): codes by class and by source ('-' where none is noted), in one pass."""
    sets = registry.select("cls", F.coalesce("source", F.lit("-")).alias("source")).groupingSets([["cls"], ["source"]], "cls", "source").agg(F.grouping("cls").alias("by_source"), F.count(F.lit(1)).alias("n"))
    return sets.select(F.when(F.col("by_source") == 1, "source").otherwise("class").alias("kind"), F.coalesce("cls", "source").alias("name"), "n")


def inventory(registry: DataFrame) -> DataFrame:
    """One row: codes, records, codes with several records, values or persons, and whether the registry may be used."""
    per = registry.groupBy("token").agg(F.count(F.lit(1)).alias("r"), F.count_distinct("value").alias("v"), F.count_distinct("identity").alias("p"))
    return per.agg(
        F.count(F.lit(1)).alias("codes"), F.sum("r").alias("records"), F.count_if(F.col("r") > 1).alias("repeated"), F.count_if(F.col("v") > 1).alias("conflicts"),
        F.count_if(F.col("p") > 1).alias("glued"), (F.count_if((F.col("r") > 1) | (F.col("v") > 1) | (F.col("p") > 1)) == 0).alias("usable"),
    )


def bindings_tag(masked_tokens: Column, bindings: Column) -> Column:
    """A hash of the bindings that a coded text rests on: tokens and identities in order. A cached text is good while it stays equal."""
    return F.sha2(F.concat_ws("\x1f", F.array_sort(F.zip_with(masked_tokens, bindings, lambda t, i: F.concat_ws("=", t, i)))), 256)


def cache_key(text: Column, signature: Column) -> Column:
    """The key of a coded text: its own hash with the signature of the dictionary it was coded under."""
    return F.sha2(F.concat_ws("\x1f", signature, F.sha2(text, 256)), 256)


def still_valid(cache: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of ``cache`` (cache_key, tokens, tag, ...) all of whose codes still stand for the same identities."""
    each = cache.select("cache_key", "tag", F.posexplode_outer("tokens").alias("at", "token"))
    met = each.join(registry.select("token", "identity"), "token", "left")
    pair = F.struct("at", "token", F.coalesce("identity", F.lit("")).alias("identity"))
    now = met.groupBy("cache_key", "tag").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), pair))).alias("b"))
    tag = bindings_tag(F.transform("b", lambda x: x["token"]), F.transform("b", lambda x: x["identity"]))
    return cache.join(now.where(tag == F.col("tag")).select("cache_key"), "cache_key", "left_semi")


def within_budget(cache: DataFrame, entries: int, size: int) -> DataFrame:
    """The entries used last, no more than ``entries`` of them and ``size`` bytes in all (cache_key, bytes, last_used_at): the limit is the feature."""
    last = cache.orderBy(F.desc("last_used_at"), "cache_key").limit(entries)
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("last_used_at"), "cache_key"))
    return last.withColumn("total", total).where(F.col("total") <= size).drop("total")
