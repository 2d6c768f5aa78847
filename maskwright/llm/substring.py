"""Substring deduplication: words in a 50-word window that also starts in an earlier document go.

Windows are taken in runs that share a minimizer (a function of the window's words,
so equal windows are always compared). The passes:

1. A count-min sketch of minimizers, merged over partitions, overestimates how often
   each window occurs; runs that it shows as single are never touched again.
2. The other runs are grouped exactly, as whole stretches of words: a run that an
   earlier document has too is removed as it stands.
3. Runs that are the first of their kind, but whose minimizer also heads other
   stretches, are opened into windows, and those are grouped exactly.

Equality is that of 128 hash bits. Only the sketch's bits reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sketch
from .windows import WINDOW, Text, Words, mix

_RUN = "doc_id long, h long, s int, e int, m long, f1 long, f2 long"
_WINDOW = "doc_id long, h long, s int, f1 long, f2 long"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _key(doc_id: np.ndarray, h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One key for a place in a document; place -1 stands for the document."""
    return mix(mix(doc_id.view(np.uint64) ^ mix(h.view(np.uint64))) + (s.astype(np.int64) + 1).view(np.uint64))


def _sketched(docs: DataFrame, cells: int) -> DataFrame:
    def run(batches):
        memo, held, n = Words(), [], 0
        for b in batches:
            for i in range(len(b)):
                m = Text(_words(b.column("text")[i].as_py()), memo).runs()[2]
                held.append(m)
                n += len(m)
                if n > 2_000_000:
                    yield sketch.partial(np.concatenate(held), cells)
                    held, n = [], 0
        if n:
            yield sketch.partial(np.concatenate(held), cells)

    return docs.select("text").mapInArrow(run, sketch.SCHEMA)


def _repeated_runs(docs: DataFrame, bits, cells: int) -> DataFrame:
    def run(batches):
        memo = Words()
        for b in batches:
            out = []
            for i in range(len(b)):
                t = Text(_words(b.column("text")[i].as_py()), memo)
                first, last, m = t.runs()
                k = sketch.holds(bits.value, m, cells)
                if k.any():
                    first, last = first[k], last[k]
                    end = last + WINDOW
                    out.append((np.full(len(first), i), first, last, m[k], t.stretch(first, end, 0), t.stretch(first, end, 1)))
            if out:
                i, s, e, m, f1, f2 = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(i), b.column("h").take(i), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), _long(m), _long(f1), _long(f2)], ["doc_id", "h", "s", "e", "m", "f1", "f2"])

    return docs.mapInArrow(run, _RUN)


def _bits_of(rows: DataFrame, cells: int) -> np.ndarray:
    """A filter of the runs (doc_id, h, s) of ``rows`` and of their documents."""

    def run(batches):
        for b in batches:
            d, h, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h", "s"))
            yield sketch.partial(np.concatenate([_key(d, h, s), _key(d, h, np.full(len(s), -1, np.int32))]), cells)

    return sketch.merge(rows.select("doc_id", "h", "s").mapInArrow(run, sketch.SCHEMA), cells, 1)


def _opened(docs: DataFrame, bits, cells: int) -> DataFrame:
    def run(batches):
        memo = Words()
        for b in batches:
            ids, hs = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "h"))
            there = sketch.holds(bits.value, _key(ids, hs, np.full(len(ids), -1, np.int32)), cells)
            out = []
            for i in np.flatnonzero(there):
                t = Text(_words(b.column("text")[int(i)].as_py()), memo)
                first, last, _ = t.runs()
                k = sketch.holds(bits.value, _key(np.full(len(first), ids[i]), np.full(len(first), hs[i]), first.astype(np.int32)), cells)
                if k.any():
                    s = np.concatenate([np.arange(x, y + 1) for x, y in zip(first[k], last[k], strict=True)])
                    out.append((np.full(len(s), i), s, t.stretch(s, s + WINDOW, 0), t.stretch(s, s + WINDOW, 1)))
            if out:
                i, s, f1, f2 = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(i), b.column("h").take(i), pa.array(s.astype(np.int32)), _long(f1), _long(f2)], ["doc_id", "h", "s", "f1", "f2"])

    return docs.where("doc_id is not null").mapInArrow(run, _WINDOW)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, h, s, e: stretches of windows s..e that an earlier document has, for documents doc_id, h, text."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    cells = sketch.cells_for(chars // 70)
    bits = spark.sparkContext.broadcast(sketch.merge(_sketched(docs.where("doc_id is not null"), cells), cells, 2))
    runs = common.staged(_repeated_runs(docs.where("doc_id is not null"), bits, cells), "runs")
    bits.unpersist()
    first = runs.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.min("m").alias("m"))
    first = common.staged(first, "firsts")
    mixed = first.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m", F.lit(True).alias("mixed"))
    mixed = common.staged(mixed, "mixed")  # so that a skewed minimizer's stretches are split when they meet it
    first = common.staged(first.join(mixed, "m", "left").select("f1", "f2", "first", "mixed"), "marked")
    met = runs.select("doc_id", "h", "s", "e", "f1", "f2").join(first, ["f1", "f2"])
    met = common.staged(met.where("doc_id > first or mixed").select("doc_id", "h", "s", "e", (F.col("doc_id") > F.col("first")).alias("gone")), "met")
    to_open = met.where("not gone")
    cells2 = sketch.cells_for(2 * to_open.count())
    bits2 = spark.sparkContext.broadcast(_bits_of(to_open, cells2))
    windows = common.staged(_opened(docs, bits2, cells2), "windows")
    least = common.staged(windows.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    late = windows.join(least, ["f1", "f2"]).where("doc_id > first")
    return met.where("gone").select("doc_id", "h", "s", "e").unionByName(late.select("doc_id", "h", "s", F.col("s").alias("e")))


def remove(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and text (the kept words, joined by one space).

    Null texts have no words. A row without doc_id is neither earlier nor later than any
    other: it stays whole and takes nothing from others. Rows with one doc_id do not
    repeat each other; repeated rows each come back.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    # a document's stretches once each, however many rows have its id and text
    found = repeated_windows(rows).distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "e")).alias("gone"))

    def run(batches):
        for b in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for i in range(len(b)):
                w = _words(b.column("text")[i].as_py())
                gone = b.column("gone")[i]
                mask = np.zeros(len(w) + 1, np.int32)
                if gone.is_valid:
                    s, e = (gone.values.field(j).to_numpy() for j in (0, 1))
                    np.add.at(mask, s, 1)
                    np.add.at(mask, e + WINDOW, -1)
                mask = np.cumsum(mask[:-1]) > 0
                left = b" ".join([x for x, m in zip(w, mask.tolist(), strict=True) if not m] if mask.any() else w)
                n_words.append(len(w))
                n_removed.append(int(mask.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return rows.join(found, ["doc_id", "h"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
