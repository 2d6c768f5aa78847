"""Quality classifier: Bradley-Terry ranking of documents, thresholded at a score quantile.

Every labelled good document is preferred to every labelled bad one. The ranking
is linear in measured text features and is fitted by the logistic loss of the
feature difference of each pair, without an intercept (differences cancel it).
The cut is a quantile of the training documents' ranking scores, and scores are
mapped to 0..1 so that the cut lies at ``CUT``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A score of at least this much predicts good quality.
CUT = 0.7
#: Bound of the fit: about so many labelled documents of each class, drawn by hash.
PER_CLASS = 3000
#: Losing a good document counts as much as keeping so many bad ones, in choosing the quantile.
SPARE = 3
#: Each document of the fit meets so many of the other class.
PARTNERS = 24

FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "bar_share", "bang_share", "digit_share", "stop_share", "comma_share", "adjacent_repeats", "top_word", "type_token", "repeated_lines", "repeated_trigrams", "long_words", "decorated_words",
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+<=>@[\\]^_`{}~/")] = True
_KINDS = {"upper": np.zeros(256, bool), "lower": np.zeros(256, bool), "digit": np.zeros(256, bool), "space": np.zeros(256, bool)}
_KINDS["upper"][65:91] = True
_KINDS["lower"][97:123] = True
_KINDS["digit"][48:58] = True
_KINDS["space"][[32, *range(9, 14)]] = True
_DECORATED = tuple(b"#$%&*!|@^~")


def features(text: str | None) -> list[float]:
    """The ranking's inputs, measured over the whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = max(1, len(raw) - int(seen[_KINDS["space"]].sum()))
    letters = max(1, int(seen[_KINDS["upper"]].sum() + seen[_KINDS["lower"]].sum()))
    counts = Counter(words)
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(n) / 10,
        min(solid / n, 40) / 10,
        float(np.sqrt(seen[_KINDS["upper"]].sum() / letters)),
        float(np.sqrt(seen[_SYMBOLS].sum() / solid)),
        float(np.sqrt(seen[124] / solid)),
        float(np.sqrt(seen[33] / solid)),
        float(np.sqrt(seen[_KINDS["digit"]].sum() / solid)),
        float(np.sqrt(seen[46] / solid)),
        float(np.sqrt(seen[44] / solid)),
        float(np.sqrt(adjacent / n)),
        max(counts.values()) / (n + 20),
        10 * float(np.log(len(counts) + 10) / np.log(n + 10)),  # stays level over lengths by Heaps' law
        (len(lines) - len(set(lines))) / (len(lines) + 5),
        (max(0, n - 2) - len(grams)) / (n + 20),
        sum(c for w, c in counts.items() if len(w) > 24) / n,
        float(np.sqrt(sum(c for w, c in counts.items() if w[-1] in _DECORATED or w[0] in _DECORATED) / n)),
    ]


def fit(x: np.ndarray, label: np.ndarray, ridge: float = 2.0, steps: int = 30) -> dict:
    """Bradley-Terry weights by Newton's method on sampled pairs, and the quantile that cuts best.

    With one class only there is no pair: every document scores the same, as that class.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = np.zeros(len(FEATURES))
    if not len(good) or not len(bad):
        return {"mean": mean, "scale": scale, "w": w, "cut": 0.0, "width": 1.0, "shift": 3.0 if len(good) or not len(bad) else -3.0, "quantile": 0.0}
    rng = np.random.default_rng(7)
    a = np.concatenate([np.repeat(good, PARTNERS), rng.choice(good, len(bad) * PARTNERS)])
    b = np.concatenate([rng.choice(bad, len(good) * PARTNERS), np.repeat(bad, PARTNERS)])
    d = z[a] - z[b]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + ridge * 1e-3 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    low, high = np.sort(s[bad]), np.sort(s[good])
    ranked = np.quantile(s, q := np.linspace(0, 1, 201))
    errors = np.array([SPARE * (high < t).mean() + (low >= t).mean() for t in ranked])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    k = best[len(best) // 2]
    width = max(1e-6, float(np.std(s)) / 4)
    return {"mean": mean, "scale": scale, "w": w, "cut": float(ranked[k]), "width": width, "shift": float(np.log(CUT / (1 - CUT))), "quantile": float(q[k])}


def rank(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores in 0..1; exactly CUT at the cut."""
    s = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"]
    return 1 / (1 + np.exp(-np.clip((s - model["cut"]) / model["width"] + model["shift"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Fit on about ``per_class`` labelled documents a class (never held-out ones), one row an id: of several the one with the least features."""
    picked = common.label_sample(labels.select("doc_id", "quality"), "quality", 4, 2, per_class)
    text = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )

    each = text.select("doc_id", "label", "text").mapInArrow(measure, "doc_id long, label int, x array<double>")
    rows = each.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()  # one an id, however often it is repeated
    rows.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label for r in rows]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, repeated rows included.

    Null texts count as empty, and an empty text has all features zero; a null
    doc_id is not held out. No row is dropped and none is moved: one map over the input.
    """

    def apply(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            s = rank(model, x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", common.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the model predicts good, all columns as they were."""
    names = docs.columns

    def apply(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(rank(model, x) >= CUT))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(apply, docs.schema)
