"""The dictionary of known values: keyed digests and forms, additions and removals, layers, combinations, noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import codes, normalize


def keyed(values: DataFrame, key: bytes) -> DataFrame:
    """(cls, digest) of values (cls, value) that have a canonical form."""
    norm = normalize.normalize(F.col("cls"), F.col("value"))
    return values.withColumn("norm", norm).where("norm is not null").select("cls", codes.value_digest(F.col("cls"), F.col("norm"), key).alias("digest")).distinct()


def lookup(candidates: DataFrame, digests: DataFrame) -> DataFrame:
    """Candidates (with cls, digest) that the dictionary knows. The planner broadcasts the dictionary if it is small."""
    return candidates.join(digests.select("cls", "digest"), ["cls", "digest"], "left_semi")


def known_numbers(runs: DataFrame, digests: DataFrame, key: bytes) -> DataFrame:
    """Number runs (with raw) that are client or document numbers; the class C goes before I."""
    both = runs.select("*", F.explode(F.array(F.lit("C"), F.lit("I"))).alias("as_cls"))
    both = both.withColumn("digest", codes.value_digest(F.col("as_cls"), normalize.normalize(F.col("as_cls"), F.col("raw")), key))
    met = both.join(digests.select(F.col("cls").alias("as_cls"), "digest"), ["as_cls", "digest"], "left_semi")
    return met.groupBy(*runs.columns).agg(F.min("as_cls").alias("cls"))


def unambiguous(pairs: DataFrame, form: str = "form", base: str = "base") -> DataFrame:
    """(form, base) of forms that lead to one base only; a form of several is dropped wholly."""
    return pairs.groupBy(form).agg(F.min(base).alias(base), F.count_distinct(base).alias("n")).where("n = 1").drop("n")


def resolve(candidates: DataFrame, forms: DataFrame, digests: DataFrame) -> DataFrame:
    """Candidates (cls, digest) with identity: the base of a known form first, else the digest itself if known."""
    exact = digests.select("cls", "digest", F.lit(True).alias("exact"))
    met = candidates.join(forms.select("cls", F.col("form").alias("digest"), "base"), ["cls", "digest"], "left").join(exact, ["cls", "digest"], "left")
    return met.withColumn("identity", F.concat(F.lit("pd:"), F.coalesce("base", F.when(F.col("exact"), F.col("digest"))))).drop("base", "exact")


def add(digests: DataFrame, forms: DataFrame, new_digests: DataFrame, new_forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary with new values. Forms come only with values that are new, never for a form
    that is a value itself or already leads elsewhere."""
    fresh = new_digests.join(digests, ["cls", "digest"], "left_anti")
    usable = new_forms.join(fresh.withColumnRenamed("digest", "base"), ["cls", "base"], "left_semi")
    usable = usable.join(digests.withColumnRenamed("digest", "form"), ["cls", "form"], "left_anti").join(forms.select("cls", "form"), ["cls", "form"], "left_anti")
    return digests.unionByName(fresh), forms.unionByName(usable.select(*forms.columns))


def remove(digests: DataFrame, forms: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary without the values ``gone`` (cls, digest), nor forms of them or equal to them."""
    base, form = gone.select("cls", F.col("digest").alias("base")), gone.select("cls", F.col("digest").alias("form"))
    return digests.join(gone, ["cls", "digest"], "left_anti"), forms.join(base, ["cls", "base"], "left_anti").join(form, ["cls", "form"], "left_anti")


def not_covered(values: DataFrame, layer: DataFrame) -> DataFrame:
    """Values (cls, value) whose key the open layer lacks."""
    own = values.withColumn("k", normalize.identity_key(F.col("value")))
    return own.join(layer.select("cls", normalize.identity_key(F.col("value")).alias("k")).distinct(), ["cls", "k"], "left_anti").select("cls", "value").distinct()


def collected(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(value) of all name sources, and per source how many it has and how many no other has."""
    each = reduce(DataFrame.unionByName, [df.select("value").distinct().withColumn("source", F.lit(n)) for n, df in sources.items()])
    by_value = each.groupBy("value").agg(F.count_distinct("source").alias("sources"))
    share = each.join(by_value, "value").groupBy("source").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.col("sources") == 1).alias("only_here"))
    return by_value.select("value"), share


def combos(cards: DataFrame, key: bytes) -> DataFrame:
    """(digest) of all pairs, and of the first three, of each card's name parts."""
    names = F.filter(F.transform("parts", normalize.identity_key), lambda n: n != "")
    n = F.col("names")
    pairs = F.flatten(F.transform(n, lambda a, i: F.transform(F.slice(n, i + 2, F.size(n)), lambda b: F.array(a, b))))
    triple = F.when(F.size(n) >= 3, F.array(F.slice(n, 1, 3))).otherwise(F.array().cast("array<array<string>>"))
    each = cards.select(names.alias("names")).select(F.explode(F.concat(pairs, triple)).alias("combo"))
    return each.select(codes.combo_digest(F.col("combo"), key).alias("digest")).where("digest is not null").distinct()


def roots(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(form, root): forms followed to the base that has none itself. A form of several bases, or on a circle, is its own root.

    Pointer doubling: each round halves what is left of every path.
    """
    parents = unambiguous(edges.where("form != base"))
    names = edges.select(F.col("form").alias("v")).union(edges.select("base")).distinct()
    at = names.join(parents.withColumnRenamed("form", "v"), "v", "left").select("v", F.coalesce("base", "v").alias("up"), F.col("base").isNull().alias("ended")).checkpoint()
    for _ in range(rounds):
        over = at.select(F.col("v").alias("up"), F.col("up").alias("next"), F.col("ended").alias("next_ended"))
        moved = at.join(over, "up").select("v", F.when(F.col("ended"), F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("ended") | F.col("next_ended")).alias("ended")).checkpoint()
        left = moved.where("not ended").count()
        done = left in (0, at.where("not ended").count())
        at = moved
        if done:
            break
    return at.select(F.col("v").alias("form"), F.when(F.col("ended"), F.col("up")).otherwise(F.col("v")).alias("root"))


def noise(words: DataFrame, digests: DataFrame, key: bytes) -> DataFrame:
    """Per category of service words (category, word): checked, and present among the persons of the dictionary."""
    asked = words.distinct().withColumn("digest", codes.value_digest(F.lit("P"), normalize.name(F.col("word")), key)).withColumn("cls", F.lit("P"))
    known = digests.select("cls", "digest", F.lit(1).alias("hit"))
    return asked.join(known, ["cls", "digest"], "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("checked"), F.count("hit").alias("present"), F.array_sort(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("word")))).alias("words")
    )


def capped(rows: DataFrame, order: list[Column], key: list[str], limit: int = 50) -> DataFrame:
    """Rows (of one ``key`` each) with verdict: the first ``limit`` by ``order`` are accepted, others over the limit.

    Each task keeps its own first ones, so no task sorts the table; the cap itself is the feature.
    """
    first = rows.orderBy(*order).limit(limit).select(*key, F.lit("accepted").alias("verdict"))
    return rows.join(F.broadcast(first), key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("over_limit")))


def first_values(rows: DataFrame) -> DataFrame:
    """Rows (cls, value, ord) without repeats of a value in any case; the first stays."""
    first = F.min_by(F.struct(*rows.columns), F.struct("ord", "value")).alias("r")
    return rows.groupBy("cls", F.lower("value").alias("k")).agg(first).select("r.*")


def classify_field(value: Column) -> Column:
    """struct(cls, cleaned, reason) of a free field: what it holds, or why nothing."""
    cleaned = normalize.collapsed(value)
    d, letters = normalize.digits(cleaned), cleaned.rlike(r"\p{L}")
    out = lambda cls, v, why: F.struct(F.lit(cls).cast("string").alias("cls"), v.alias("cleaned"), F.lit(why).alias("reason"))
    return (
        F.when(cleaned == "", out(None, cleaned, "empty"))
        .when(F.lower(cleaned).isin("-", "--", "нет", "n/a", "none", "null", "не указано", "test", "тест"), out(None, cleaned, "placeholder"))
        .when(normalize.email(cleaned).isNotNull(), out("E", normalize.email(cleaned), "email"))
        .when(~letters & (F.length(d) >= 7), out("T", d, "phone"))
        .when(~letters, out(None, cleaned, "digits"))
        .otherwise(out("P", cleaned, "name"))
    )


def shape_class(value: Column) -> Column:
    """What a value is by its shape alone: T, E, D, C (all digits, shorter than a telephone) or P; null for nothing."""
    v = normalize.collapsed(value)
    d, letters = normalize.digits(v), v.rlike(r"\p{L}")
    return (
        F.when(v == "", None)
        .when(normalize.email(v).isNotNull(), "E")
        .when(normalize.split_birth_date(v).isNotNull(), "D")
        .when(~letters & (F.length(d) >= 7), "T")
        .when(~letters & (F.length(d) >= 3), "C")
        .when(letters, "P")
    )


def noise_kind(value: Column, in_layer: Column, own: Column) -> Column:
    """Why a would-be name is noise, null if it is none: what the open layer has never is; else empty, own_word, digits within, one letter, or too many words."""
    v = normalize.collapsed(value)
    return (
        F.when(F.coalesce(in_layer, F.lit(False)), None)
        .when(v == "", "empty")
        .when(own, "own_word")
        .when(v.rlike("[0-9]"), "digits")
        .when(F.length(F.regexp_replace(v, r"[^\p{L}]", "")) < 2, "one_letter")
        .when(F.size(F.split(v, " ")) > 4, "sentence")
    )


def lexicon(spark, raw: dict[str, list[str]]) -> DataFrame:
    """(category, word) of a service lexicon, for measuring only: blank words and repeats are left out, categories in order."""
    rows = dict.fromkeys((c.strip().lower(), " ".join(w.split()).lower()) for c, ws in raw.items() for w in ws if w.strip())
    return spark.createDataFrame(list(rows) or [("", "")], "category string, word string").where("word != ''")
