"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

N-grams of 3 to 6 code points of the lower-cased text are hashed to ``BUCKETS``
buckets and counted once a document. Each bucket's input is its log-count ratio
between toxic and other training documents, and a logistic regression is fitted
on those inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A score of at least this much predicts toxic.
CUT = 0.5
#: Bound of the fit: about so many labelled documents of each class, drawn by hash.
PER_CLASS = 2000
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: A bucket takes part if so many training documents hold it.
LEAST_DOCS = 8
#: ... and its ratio is at least this far from even.
LEAST_RATIO = 1.5

_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every n-gram of the whole text, repeats included; a null text has those of an empty one."""
    s = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    s[(s == 10) | (s == 9) | (s == 13)] = 32
    out = []
    h = s.copy()
    for size in range(2, max(SIZES) + 1):
        if len(s) < size:
            break
        h = h[:-1] * np.uint64(1_000_003) + s[size - 1 :]
        if size in SIZES:
            out.append(((h * _MIX + np.uint64(size)) * _MIX >> np.uint64(44)).astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def ratios(p: np.ndarray, q: np.ndarray, toxic: int, others: int) -> np.ndarray:
    """Log-count ratio of each bucket by the toxic (p) and other (q) documents that hold it; 0 where it takes no part."""
    ratio = np.log(((p + 1) / (toxic + 2)) / ((q + 1) / (others + 2)))
    ratio[(p + q < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def fit(docs: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, l2: float = 2e-3, steps: int = 300) -> dict:
    """Logistic regression on the scaled inputs (full-batch, momentum). ``docs`` hold buckets with a ratio only.

    With one class only, every document scores as that class.
    """
    n = len(docs)
    toxic = int(label.sum())
    weights = np.zeros(BUCKETS, np.float32)
    if not n or toxic in (0, n):
        return {"w": weights, "b": 3.0 if n and toxic else -3.0}
    col, row = np.concatenate(docs), np.repeat(np.arange(n), [len(d) for d in docs])
    used, col = np.unique(col, return_inverse=True)
    x = ratio[used][col]
    balance = np.where(label == 1, n / (2 * toxic), n / (2 * (n - toxic))) / n
    w, b, vw, vb = np.full(len(used), 0.02), 0.0, np.zeros(len(used)), 0.0
    for t in range(steps):
        z = np.bincount(row, x * w[col], n) + b
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        gw = np.bincount(col, x * g[row], len(used)) + l2 * w
        vw, vb = 0.9 * vw + gw, 0.9 * vb + g.sum()
        rate = 0.08 / (1 + t / 100)
        w, b = w - rate * vw, b - rate * vb
    weights[used] = ratio[used] * w
    weights[np.abs(weights) < 1e-4] = 0
    return {"w": weights, "b": float(b)}


def score_text(model: dict, text: str | None) -> float:
    w = model["w"]
    hit = buckets(text)
    hit = hit[w[hit] != 0]
    z = model["b"] + float(w[np.unique(hit)].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Fit on about ``per_class`` labelled documents a class (never held-out ones), one row an id: of several the one with the least buckets.

    Buckets are counted where the documents lie (at most ``BUCKETS`` sums come to the driver); then each
    document brings only the buckets that have a ratio.
    """
    picked = common.label_sample(labels.select("doc_id", "toxic"), "toxic", 5, 0, per_class)
    text = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def measure(batches):
        for b in batches:
            found = [np.unique(buckets(t)).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "x"])

    each = text.select("doc_id", "label", "text").mapInArrow(measure, "doc_id long, label int, x binary")
    each = common.staged(each.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")), "toxic")

    def count(batches):
        held = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for y, x in zip(b.column("label").to_pylist(), b.column("x"), strict=True):
                held[y][np.frombuffer(x.as_py(), np.int32)] += 1
        at = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[1][at], pa.int64()), pa.array(held[0][at], pa.int64())], ["bucket", "p", "q"])

    sums = each.mapInArrow(count, "bucket int, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= LEAST_DOCS)
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    counted = sums.toArrow()
    at = counted["bucket"].to_numpy()
    p[at], q[at] = counted["p"].to_numpy(), counted["q"].to_numpy()
    sizes = {r.label: r["count"] for r in each.groupBy("label").count().collect()}
    ratio = ratios(p, q, sizes.get(1, 0), sizes.get(0, 0))
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(ratio != 0))

    def informative(batches):
        bits = np.unpackbits(sent.value).astype(bool)
        for b in batches:
            kept = [x[bits[x]].tobytes() for x in (np.frombuffer(v.as_py(), np.int32) for v in b.column("x"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(kept, pa.binary())], ["doc_id", "label", "x"])

    # The rows are few, but each may be long: they come over one partition at a time.
    rows = sorted((r.doc_id, bytes(r.x), r.label) for r in each.mapInArrow(informative, "doc_id long, label int, x binary").toLocalIterator())
    return fit([np.frombuffer(x, np.int32) for _, x, _ in rows], np.array([y for *_, y in rows], np.int64), ratio)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, repeated rows included.

    Null texts count as empty; a null doc_id is not held out. One map over the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_sparse(model))

    def apply(batches):
        m = _dense(shared.value)
        for b in batches:
            s = np.array([score_text(m, t) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def _sparse(model: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """The model as it is sent out: BUCKETS bounds its size."""
    at = np.flatnonzero(model["w"])
    return at, model["w"][at], model["b"]


def _dense(sent: tuple[np.ndarray, np.ndarray, float]) -> dict:
    w = np.zeros(BUCKETS, np.float32)
    w[sent[0]] = sent[1]
    return {"w": w, "b": sent[2]}
