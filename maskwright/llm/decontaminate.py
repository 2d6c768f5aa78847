"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are compared by hash, whatever stands between them. Fixed masks ignore some of
six neighbouring words; the hashes of all masked places of the benchmark are joined
with those of all places of the documents. At each hit the passage and the document
are laid over each other, and the hit stands if in some window of the passage (all of
it, if shorter) at least four fifths of the words agree. The two masks together miss
no window of 8 to 20 words with so few substitutions (tests go through every case). Passages
of fewer words are found where all their words stand in a row, by a mask that ignores none.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Places of the seed's words that count.
MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
#: A place needs so many words; a mask that reaches over the end hashes those that are there.
SPAN = 5
#: Words of a verified window, the share of them that must agree, and words from which a passage may be substituted in.
WINDOW, SHARE, TOLERANT = 20, 0.8, 8
#: Words of the shortest passage for whose sake a document is dropped: fewer are found, but they are common speech.
EVIDENCE = 8
#: Benchmark seeds that are sent to every task at once; more are taken in blocks of passages.
SENT = 1_500_000


def hashed_words(text: Column) -> Column:
    """Hashes of the text's words: runs of letters and digits, lower-cased. Null texts have none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _seeds(h: str, lengths: list[int]) -> Column:
    """Hashes of the place i under each mask; null where a passage of that length can't start."""
    n = F.size(h)
    at = lambda k: F.get(F.col(h), F.col("i") + k)
    masked = [F.when(n - F.col("i") >= SPAN, F.xxhash64(F.lit(k), *(at(j) for j in mask))) for k, mask in enumerate(MASKS)]
    return F.array(*masked, *(F.when(n - F.col("i") >= k, F.xxhash64(F.lit(-k), *(at(j) for j in range(k)))) for k in lengths))


def _places(rows: DataFrame, h: str, keep: list[str], lengths: list[int]) -> DataFrame:
    """A row for each masked place: the columns ``keep``, its position i and its hash seed."""
    n, least = F.size(h), min([SPAN, *lengths])
    at = F.when(n >= least, F.sequence(F.lit(0), n - least)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("i", F.explode(at)).withColumn("seed", F.explode(_seeds(h, lengths))).where("seed is not null").select(*keep, "i", "seed")


def passages(benchmark: DataFrame) -> DataFrame:
    """item_no, item_id, g, n: every passage that has words; those of equal words have one item_no."""
    words = benchmark.select("item_id", hashed_words(F.col("text")).alias("g")).where(F.size("g") > 0)
    return words.select(F.xxhash64("g").alias("item_no"), "item_id", "g", F.size("g").alias("n")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, h, item_id, agreeing, window: the passages found in each document, with the best window of each.

    ``h`` is xxhash64(text), which tells rows with one doc_id apart. Documents are read in
    place: only verified hits are shuffled. The benchmark is sent out in blocks of at most
    SENT seeds, so its size is checked whatever it is; equal passages are sought once and told under each id.
    Null texts match nothing, and passages without words are in no text.
    """
    every = common.staged(passages(benchmark), "passages")
    items = every.select("item_no", "g", "n").distinct()
    lengths = sorted(r.n for r in items.where(F.col("n") < TOLERANT).select("n").distinct().collect())
    whole = items.where(F.col("n") >= TOLERANT)
    seeds = _places(whole, "g", ["item_no"], []).withColumnRenamed("i", "off")
    for k in lengths:  # a short passage has one place
        seeds = seeds.unionByName(items.where(F.col("n") == k).select("item_no", F.lit(0).alias("off"), F.xxhash64(F.lit(-k), *(F.get("g", F.lit(j)) for j in range(k))).alias("seed")))
    seeds = common.staged(seeds.distinct(), "seeds")
    blocks = max(1, math.ceil(seeds.count() / SENT))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), hashed_words(F.col("text")).alias("words"))
    found = []
    for b in range(blocks):
        mine = lambda df: df if blocks == 1 else df.where(F.pmod("item_no", F.lit(blocks)) == b)  # noqa: E731, B023
        met = _places(rows, "words", ["doc_id", "h", "words"], lengths).join(F.broadcast(mine(seeds)), "seed")
        laid = met.select("doc_id", "h", "words", "item_no", (F.col("i") - F.col("off")).alias("d")).join(F.broadcast(mine(items)), "item_no")
        agree = F.transform("g", lambda x, j: F.when((F.col("d") + j >= 0) & (F.get("words", F.col("d") + j) == x), 1).otherwise(0))
        window = F.least("n", F.lit(WINDOW))
        need = F.when(F.col("n") < TOLERANT, F.col("n")).otherwise(F.ceil(window * F.lit(SHARE)).cast("int"))
        flags = laid.select("doc_id", "h", "item_no", agree.alias("flags"), window.alias("window"), need.alias("need"), "n")
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
        some = flags.where(total(F.col("flags")) >= F.col("need"))
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("window") + 1), lambda s: total(F.slice("flags", s, F.col("window")))))
        found.append(some.select("doc_id", "h", "item_no", best.alias("agreeing"), "window", "need").where("agreeing >= need"))
    per = reduce(DataFrame.unionByName, found).groupBy("doc_id", "h", "item_no").agg(F.max("agreeing").alias("agreeing"), F.max("window").alias("window"))
    return per.join(every.select("item_no", "item_id"), "item_no").drop("item_no")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agreeing, window: one row for each passage that a document holds.

    Documents that hold none have no row; repeated rows have one between them.
    """
    found = hits(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.max("window").alias("window"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = EVIDENCE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage of at least ``least`` words; all columns stay."""
    known = benchmark.where(F.size(hashed_words(F.col("text"))) >= least)
    bad = hits(docs, known).select(F.struct("doc_id", "h").alias("k")).distinct()
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.alias("a").join(bad.alias("b"), F.expr("a.k.doc_id <=> b.k.doc_id and a.k.h = b.k.h"), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
