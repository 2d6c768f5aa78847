"""Spans of text as arrays of structs, by expressions: found by regular expression, and merged.

A span is struct(start, end, cls, raw, norm, suffix, src, ord); positions count code points from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,cls:string,raw:string,norm:string,suffix:string,src:int,ord:int>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(start: Column, end: Column, cls: Column, raw: Column, norm: Column, src: int, ord_: Column, suffix: Column | None = None) -> Column:
    cols = (("start", start, "int"), ("end", end, "int"), ("cls", cls, "string"), ("raw", raw, "string"), ("norm", norm, "string"), ("suffix", F.lit("") if suffix is None else suffix, "string"), ("src", F.lit(src), "int"), ("ord", ord_, "int"))
    return F.struct(*(c.cast(kind).alias(n) for n, c, kind in cols))


def matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """array<struct(start, raw)> of all matches; the pattern can't match nothing.

    Texts between matches and matches alternate, so a match starts after all of both before it.
    ``hint``, a cheap pattern that any text with a match holds, spares the others the search.
    """
    text = F.coalesce(text, F.lit(""))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("raw"), gap.alias("gap")))
    empty = F.array().cast("array<struct<start:int,raw:string>>")
    end = lambda acc: F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.element_at(acc, -1)["start"] + F.length(F.element_at(acc, -1)["raw"]))
    add = lambda acc, p: F.concat(acc, F.array(F.struct((end(acc) + F.length(p["gap"])).cast("int").alias("start"), p["raw"].alias("raw"))))
    step = lambda acc, p: F.when(p["raw"].isNull(), acc).otherwise(add(acc, p))
    some = text.rlike(pattern) if hint is None else text.rlike(hint) & text.rlike(pattern)
    return F.when(some, F.aggregate(pairs, empty, step)).otherwise(empty)


def find(text: Column, pattern: str, cls: str, src: int, norm: Callable[[Column], Column], keep: Callable[[Column, Column, Column], Column] | None = None, hint: str | None = None) -> Column:
    """Spans of a pattern whose value has a canonical form, and that ``keep(text, start, raw)`` accepts."""
    some = F.transform(matches(text, pattern, hint), lambda m, i: span(m["start"], m["start"] + F.length(m["raw"]), F.lit(cls), m["raw"], norm(m["raw"]), src, i))
    good = lambda s: s["norm"].isNotNull() if keep is None else s["norm"].isNotNull() & keep(text, s["start"], s["raw"])
    return F.filter(some, good)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def merge(spans: Column, drop: Callable[[Column], Column] | None = None) -> Column:
    """Spans without overlap: earliest first, of equal starts the longest, then by class and detector."""
    order = F.array_sort(
        F.filter(spans, lambda s: (s["end"] > s["start"]) & (~drop(s) if drop else F.lit(True))),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .when(a["cls"] < b["cls"], -1).when(a["cls"] > b["cls"], 1)
        .when(a["src"] != b["src"], a["src"] - b["src"])
        .otherwise(a["ord"] - b["ord"]),
    )
    take = lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(acc)
    return F.when(F.size(spans) > 0, F.aggregate(order, none(), take)).otherwise(none())
