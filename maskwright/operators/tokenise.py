"""From text to coded text: detect, code, splice, replace what is left, and count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import arrow, codes

from . import detect


def with_spans(df: DataFrame, text: str = "text", detector: Callable[[Column], Column] = detect.rules) -> DataFrame:
    """``df`` with spans: merged findings of the detector. The column is made once, before it is used."""
    return df.withColumn("spans", detector(F.col(text)))


def code_of(span: Column, key: bytes) -> Column:
    return codes.code(span["cls"], span["norm"], key)


def first_codes(spans: Column, key: bytes) -> Column:
    """The first-choice code of each span, in their order."""
    return F.transform(spans, lambda s: code_of(s, key))


def tokenise(df: DataFrame, key: bytes, text: str = "text", detector: Callable[[Column], Column] = detect.rules) -> DataFrame:
    """``df`` with spans and masked: each finding replaced by its first-choice code.

    ``engine.protect`` asks all detectors and the registry, whose codes are free of collisions. Null texts stay null.
    """
    found = with_spans(df, text, detector)
    return found.withColumn("masked", arrow.spliced(F.col(text), F.col("spans"), first_codes(F.col("spans"), key)))


def second_pass(text: Column, spans: Column, put: Column) -> Column:
    """Replace what the first pass left of the found values, in any case and spacing, by ``put``, the spans' codes; longest values first."""
    return arrow.replaced_left(text, F.transform(spans, lambda s: s["raw"]), put)


def class_counts(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Findings by class (and ``keys``): one row is made per finding, then summed in the tasks first.

    The outer explode keeps the planner from inferring a filter on the spans, which it would
    push below them by finding them a second time.
    """
    keys = keys or []
    each = found.select(*keys, F.explode_outer("spans.cls").alias("cls")).where("cls is not null")
    return each.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("findings"))


def long_form(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding: keys, ord and the span's fields."""
    each = found.select(*keys, F.posexplode_outer("spans").alias("ord", "s")).where("s is not null")
    return each.select(*keys, "ord", "s.start", "s.end", "s.cls", "s.raw", "s.norm")
