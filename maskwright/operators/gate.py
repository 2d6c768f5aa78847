"""The residual gate: nothing found in an original text may be readable in the text that goes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import arrow

from . import detect

PASSES, SAMPLES, SHOWN = 3, 3, 25


def unmasked(outgoing: Column, detector: Callable[[Column], Column] = detect.rules) -> Column:
    """Findings in an outgoing text that don't touch a code (no original to compare with)."""
    return arrow.free(detector(outgoing), detect.code_spans(outgoing))


def survivors(original: Column, spans: Column, outgoing: Column) -> Column:
    """Findings of the original that can still be read in the outgoing text, but for those inside links."""
    return F.transform(arrow.survivors(original, spans, outgoing), lambda i: F.get(spans, i))


def masked_sample(original: Column, span: Column) -> Column:
    """A value shown without showing it: two letters, its length, and the shape around it in dots."""
    value = F.trim(F.regexp_replace(span["raw"], r"(?U)\s+", " "))
    left = F.greatest(F.lit(0), span["start"] - SHOWN)
    shape = F.regexp_replace(F.substring(original, left + 1, span["end"] + SHOWN - left), r"(?U)\w", "•")
    head = F.when(F.length(value) > 2, F.concat(F.substring(value, 1, 2), F.lit("…"))).otherwise(F.lit("…"))
    return F.concat(head, F.lit("("), F.length(value).cast("string"), F.lit(") | "), shape)


def repair(df: DataFrame, put: Column, passes: int = PASSES) -> DataFrame:
    """``df`` (original, spans, outgoing) with outgoing repaired: survivors replaced by ``put``, the codes of the spans.

    Up to ``passes`` times; the ``survivors`` left are for the verdict. A text that passes the gate is not touched.
    """
    df = df.withColumn("_done", arrow.finished(F.col("original"), F.col("spans"), put, F.coalesce("outgoing", F.lit("")), passes))
    return df.withColumn("outgoing", F.col("_done.text")).withColumn("survivors", F.transform("_done.left", lambda i: F.get("spans", i))).drop("_done")


def verdict(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: clean, and for each class of survivors its count and up to three masked samples."""
    each = df.select(*keys, F.explode_outer("survivors").alias("s"), "original").withColumn("cls", F.col("s.cls")).withColumn("sample", masked_sample(F.col("original"), F.col("s")))
    by_class = each.groupBy(*keys, "cls").agg(F.count("cls").alias("findings"), F.slice(F.array_sort(F.collect_set("sample")), 1, SAMPLES).alias("samples"))
    reasons = F.filter(F.array_sort(F.collect_list(F.struct("cls", "findings", "samples"))), lambda r: r["cls"].isNotNull())
    return by_class.groupBy(*keys).agg(reasons.alias("reasons")).withColumn("clean", F.size("reasons") == 0)
