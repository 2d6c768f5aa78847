"""Hidden Markov language model over word classes, trained by Baum-Welch on the whole corpus.

A text is the sequence of its words and one end token. Each token has a class:
the ``OWN`` most frequent tokens have one of their own, others share one by their
ending and shape. States emit classes, and a class emits its tokens by add-one
counts, with one share for all unknown tokens of the class; so

    P(text) = P(classes | HMM) * product of P(token | class)

is a distribution over texts, computed exactly by the scaled forward recursion.

Each Baum-Welch pass sums expected transition and emission counts of every
partition of the training texts. The starting point comes from a mixture of
unigram models on the counts of all training texts, summed in groups by the one of
the ``MARKERS`` most frequent tokens that a text has most beyond its share.
"""

from __future__ import annotations

import struct
from collections import Counter
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Stands for the end of a text; no word holds a line break.
END = b"\n"
STATES = 8
#: Tokens with a class of their own (class 0 is the end token's), and shared classes.
OWN, SHARED = 4096, 2048
#: Most frequent tokens whose counts are sent to every task; the counts of others are joined.
SENT = 65_536
#: A longer token goes by 16 bytes of its hash after a blank, which no word holds: any frequent token is small enough to be sent.
LONGEST = 64
PASSES = 2
#: Markers: the most frequent tokens, which tell texts of one language or kind from others.
MARKERS = 64
#: Padded tokens of one forward-backward step, and distinct tokens that a task counts before it hands them on.
CELLS, HELD = 1_000_000, 300_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of the whole text, then the end token; null counts as empty."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    if out and max(map(len, out)) > LONGEST:
        out = [w if len(w) <= LONGEST else b" " + blake2b(w, digest_size=16).digest() for w in out]
    out.append(END)
    return out


class Classes(dict):
    """Class of each token; remembers some of those that it works out."""

    def __init__(self, own: list[bytes]):
        super().__init__({w: i + 1 for i, w in enumerate(own)})
        self[END] = 0
        self.room = len(self) + HELD

    def __missing__(self, w: bytes) -> int:
        shape = (w[0] < 97) + 2 * (w[-1] < 97)
        k = OWN + crc32(w[-4:] if w[-1] > 96 else w[-5:], shape) % SHARED
        if len(self) < self.room:
            self[w] = k
        return k


class Sent(dict):
    """Place of each token whose count is sent; for any other -1 - its class."""

    def __init__(self, top: list[bytes], own: list[bytes]):
        super().__init__({w: i for i, w in enumerate(top)})
        self.classes = Classes(own)
        self.class_of = np.array([self.classes[w] for w in top] or [0], np.int32)

    def __missing__(self, w: bytes) -> int:
        return -1 - self.classes[w]


def _batches(column: pa.Array):
    """The texts of an Arrow column, one at a time."""
    for i in range(len(column)):
        yield column[i].as_py()


def count(docs: DataFrame) -> DataFrame:
    """word, c: every token of ``docs`` with its count; summed in the tasks first."""

    def partial(batches):
        held: Counter = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in batches:
            for t in _batches(b.column("text")):
                held.update(words(t))
                if len(held) > HELD:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def by_length(seqs: list[np.ndarray]):
    """Groups of sequences as (T, B) arrays of classes, longest first, padded to at most CELLS, with their lengths and places."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        t = len(seqs[order[at]])
        part = order[at : at + max(1, CELLS // t)]
        at += len(part)
        n = np.array([len(seqs[i]) for i in part])
        x = np.zeros((t, len(part)), np.int32)
        for j, i in enumerate(part):
            x[: n[j], j] = seqs[i]
        yield x, n, part


def forward(model: dict, x: np.ndarray, n: np.ndarray, keep: bool = False):
    """Natural log-likelihood of each sequence by the scaled recursion; ``keep``: also the scaled variables."""
    a, et = model["a"], model["et"]
    live = np.searchsorted(-n, -np.arange(len(x)), side="left")  # sequences longer than t
    log = np.zeros(len(n))
    alphas = np.empty((*x.shape, a.shape[0]), np.float32) if keep else None
    scales = np.ones(x.shape) if keep else None
    alpha = model["pi"] * et[x[0]]
    for t in range(len(x)):
        if t:
            m = live[t]
            alpha = (alpha[:m] @ a) * et[x[t, :m]]
        s = alpha.sum(1)
        alpha = alpha / s[:, None]
        log[: len(s)] += np.log(s)
        if keep:
            alphas[t, : len(s)] = alpha
            scales[t, : len(s)] = s
    return (log, alphas, scales, live) if keep else log


def expected(model: dict, x: np.ndarray, n: np.ndarray, into: dict) -> None:
    """Add the expected counts of some sequences to ``into``."""
    a, et, k = model["a"], model["et"], len(model["pi"])
    log, gamma, scales, live = forward(model, x, n, keep=True)
    beta = np.ones((len(n), k))
    move = np.zeros((k, k))
    for t in range(len(x) - 1, -1, -1):
        m = live[t]
        if t + 1 < len(x) and live[t + 1]:
            u = live[t + 1]
            back = et[x[t + 1, :u]] * beta[:u] / scales[t + 1, :u, None]
            move += gamma[t, :u].T @ back
            beta[:u] = back @ a.T
        gamma[t, :m] *= beta[:m]
    into["pi"] += gamma[0].sum(0)
    into["a"] += move * a
    real = np.arange(len(x))[:, None] < n
    classes, g = x[real], gamma[real]
    for j in range(k):
        into["e"][j] += np.bincount(classes, g[:, j], OWN + SHARED)
    into["log"] += log.sum()


def empty_counts(k: int) -> dict:
    return {"pi": np.zeros(k), "a": np.zeros((k, k)), "e": np.zeros((k, OWN + SHARED)), "log": 0.0}


def normal(c: dict, mass: np.ndarray, sizes: np.ndarray) -> dict:
    """Probabilities of expected counts. A class's add-one counts (``sizes`` against ``mass``)
    are shared out as its tokens are, and a few counts follow the overall sizes, so nothing is impossible."""
    k = len(c["pi"])
    e = c["e"] * np.where(mass > 0, sizes / np.maximum(mass, 1), 1) + 20 * sizes / sizes.sum()
    a = c["a"] + 0.1
    pi = c["pi"] + 0.1
    return {"pi": pi / pi.sum(), "a": a / a.sum(1, keepdims=True), "et": np.ascontiguousarray((e / e.sum(1, keepdims=True)).T), "k": k}


def start(hists: np.ndarray, mass: np.ndarray, sizes: np.ndarray, k: int = STATES, steps: int = 15) -> dict:
    """A first model: ``k`` unigram clusters of the rows, each a state that rarely changes. A row is the counts of one or more documents."""
    c = empty_counts(k)
    if len(hists):
        base = (mass + 0.5) / (mass + 0.5).sum()
        far = [int(np.argmax(hists.sum(1)))]
        unit = np.sqrt(hists / np.maximum(1, hists.sum(1, keepdims=True)))
        near = unit @ unit[far[0]]
        while len(far) < min(k, len(hists)):
            far.append(int(np.argmin(near)))
            near = np.maximum(near, unit @ unit[far[-1]])
        e = np.stack([hists[i] for i in far] + [mass] * (k - len(far))).astype(float)
        for _ in range(steps):
            p = e + 50 * base
            z = hists @ np.log(p / p.sum(1, keepdims=True)).T
            r = np.exp(z - z.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            e = r.T @ hists
        c["e"], c["pi"] = e, hists[:, 0] @ r  # a document has one end token
        c["a"] = np.eye(k) * e.sum(1).mean() * 0.95 + e.sum(1).mean() * 0.05 * (c["pi"] / c["pi"].sum())
    return normal(c, mass, sizes)


class Model:
    """The trained model: what the tasks are sent is bounded by SENT, OWN, SHARED and STATES."""

    def __init__(self, docs: DataFrame, rest: int = 2, mod: int = 7, passes: int = PASSES):
        spark = docs.sparkSession
        training = docs.where(~common.held_out(F.col("doc_id"), mod, rest)).select("doc_id", "text")
        self.vocabulary = common.staged(count(training), "vocabulary")
        n, v = self.vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.n, self.v = int(n or 0), int(v)
        top = self._top()
        self.top = spark.sparkContext.broadcast({bytes(r.word): r.c for r in top})
        self.own = spark.sparkContext.broadcast([w for r in top[: OWN] if (w := bytes(r.word)) != END][: OWN - 1])
        mass, kinds = self._classes()
        self.sizes = mass + kinds + 1.0  # of a shared class: its tokens' counts, one more each, and one for the unknown
        sequences = self._sequences(training)
        model = start(self._groups(sequences, mass), mass, self.sizes)
        for _ in range(passes):
            model = normal(self._pass(sequences, model), mass, self.sizes)
        self.hmm = spark.sparkContext.broadcast(model)

    def _top(self) -> list:
        """The most frequent tokens: all that reach a count that at most SENT do, most frequent first.

        The count is found from a histogram, so no task and not the driver ever sorts more than SENT rows.
        """
        grade = F.floor(F.log2("c") * 32).cast("int")
        least, total = None, 0
        for r in sorted(self.vocabulary.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r.grade):
            total += r["count"]
            if total > SENT:
                break
            least = r.grade
        rows = self.vocabulary.where(grade >= least).collect() if least is not None else []
        return sorted(rows, key=lambda r: (-r.c, bytes(r.word)))

    def _classes(self) -> tuple[np.ndarray, np.ndarray]:
        own = self.own

        def sums(batches):
            classes, mass, kinds = Classes(own.value), np.zeros(OWN + SHARED), np.zeros(OWN + SHARED)
            for b in batches:
                k = np.array([classes[w] for w in b.column("word").to_pylist()], np.int64)
                mass += np.bincount(k, b.column("c").to_numpy(), OWN + SHARED)
                kinds += np.bincount(k, minlength=OWN + SHARED)
            at = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(mass[at]), pa.array(kinds[at])], ["class", "mass", "kinds"])

        mass, kinds = np.zeros(OWN + SHARED), np.zeros(OWN + SHARED)
        for r in self.vocabulary.mapInArrow(sums, "class int, mass double, kinds double").groupBy("class").agg(F.sum("mass").alias("mass"), F.sum("kinds").alias("kinds")).collect():
            mass[r["class"]], kinds[r["class"]] = r.mass, r.kinds
        return mass, kinds

    def _sequences(self, training: DataFrame) -> DataFrame:
        """x: the classes of each training text's tokens in two bytes each, worked out once."""
        own = self.own

        def read(batches):
            classes = Classes(own.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([np.fromiter(map(classes.__getitem__, w), np.int16, len(w)).tobytes() for w in map(words, _batches(b.column("text")))], pa.binary())], ["x"])

        return common.staged(training.select("text").mapInArrow(read, "x binary"), "sequences")

    def _groups(self, sequences: DataFrame, mass: np.ndarray) -> np.ndarray:
        """Counts of classes in all training texts, a row for each group that has any: a text's group is the marker whose count exceeds its share of the corpus most."""
        rate = np.log(np.maximum(mass[1 : MARKERS + 1], 1) / max(1, mass.sum()))
        width = OWN + SHARED

        def sums(batches):
            total, held, size = np.zeros((MARKERS + 1) * width, np.int64), [], 0

            for b in batches:
                for t in _batches(b.column("x")):
                    x = np.frombuffer(t, np.int16).astype(np.int64)
                    c = np.bincount(x[x <= MARKERS], minlength=MARKERS + 1)[1:]
                    beyond = c * (np.log(np.maximum(c, 1) / len(x)) - rate)
                    held.append(x + width * (int(beyond.argmax()) if c.any() else MARKERS))
                    size += len(x)
                    if size > CELLS:
                        total += np.bincount(np.concatenate(held), minlength=len(total))
                        held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "n"])

        out = np.zeros((MARKERS + 1) * width)
        met = sequences.mapInArrow(sums, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        out[met["slot"].to_numpy()] = met["n"].to_numpy()
        out = out.reshape(-1, width)
        return out[out.any(1)]

    def _pass(self, sequences: DataFrame, model: dict) -> dict:
        """Expected counts of all training texts: summed in each task, then over tasks, slot by slot."""
        sc = sequences.sparkSession.sparkContext
        sent, k = sc.broadcast(model), model["k"]

        def sums(batches):
            into, m = empty_counts(k), sent.value
            for b in batches:
                seqs = [np.frombuffer(t, np.int16) for t in _batches(b.column("x"))]
                for x, n, _ in by_length(seqs):
                    expected(m, x, n, into)
            flat = np.concatenate([into["pi"], into["a"].ravel(), into["e"].ravel(), [into["log"]]])
            at = np.flatnonzero(np.abs(flat) > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], ["slot", "x"])

        flat = np.zeros(k + k * k + k * (OWN + SHARED) + 1)
        for r in sequences.mapInArrow(sums, "slot int, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect():
            flat[r.slot] = r.x
        sent.unpersist()
        return {"pi": flat[:k], "a": flat[k : k + k * k].reshape(k, k), "e": flat[k + k * k : -1].reshape(k, -1), "log": flat[-1]}

    def score(self, docs: DataFrame, rest: int = 2, mod: int = 7) -> DataFrame:
        """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

        Counts of frequent tokens are looked up where the text is read; each rarer token
        of a document is one row that meets its count in a shuffled join (no rare token is
        hot), and a document's rows meet again by id and text hash. Repeated rows share
        their sums evenly and each come back. A null text is the end token alone; a null id is not held out.
        """
        own, top, hmm, sizes = self.own, self.top, self.hmm, np.log10(self.sizes)
        sizes[:OWN] = 0.0

        def read(batches):
            sent, m = Sent(list(top.value), own.value), hmm.value
            logs = np.log10(np.array([*top.value.values(), 0.0]) + 1)
            shared_logs = np.where(np.append(sent.class_of, OWN)[: len(logs)] < OWN, 0.0, logs)  # alone in its class, a token is known by it
            for b in batches:
                ids, hashes = b.column("doc_id"), b.column("h")
                seqs, n_known, known_log, log, rows, rare, times = [], [], [], [], [], [], []
                for i, t in enumerate(_batches(b.column("text"))):
                    w = words(t)
                    at = np.fromiter(map(sent.__getitem__, w), np.int32, len(w))
                    known = at[at >= 0]
                    seqs.append(np.where(at < 0, -1 - at, sent.class_of[at % len(sent.class_of)]))
                    n_known.append(len(known))
                    known_log.append(logs[known].sum())
                    log.append(shared_logs[known].sum() - known_log[-1] - sizes[seqs[-1]].sum())
                    found = Counter([w[j] for j in np.flatnonzero(at < 0).tolist()])
                    rows += [i] * len(found)
                    rare += found.keys()
                    times += found.values()
                log = np.array(log)
                for x, n, part in by_length(seqs):
                    log[part] += forward(m, x, n) / np.log(10)
                heads = [b"  " + struct.pack("<q", h or 0) + struct.pack("<q", i) for i, h in enumerate(hashes.to_pylist())]
                yield _rows(ids, hashes, pa.array(heads, pa.binary()), np.ones(len(seqs)), [len(s) for s in seqs], n_known, known_log, log)
                for at in range(0, len(rows), 100_000):
                    r = pa.array(rows[at : at + 100_000], pa.int32())
                    yield _rows(ids.take(r), hashes.take(r), pa.array(rare[at : at + 100_000], pa.binary()), times[at : at + 100_000])

        def _rows(ids, hashes, word, times, *more):
            zero = np.zeros(len(word))
            n, known, known_log, log = more or (zero, zero, zero, zero)
            head = np.full(len(word), int(bool(more)))
            return pa.RecordBatch.from_arrays(
                [ids, hashes, word, pa.array(np.asarray(times, np.int64)), pa.array(head.astype(np.int32)), pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(known, np.int64)), pa.array(np.asarray(known_log, float)), pa.array(np.asarray(log, float))], _NAMES
            )

        rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(read, _ROW)
        met = rows.join(self.vocabulary, "word", "left")
        c = F.when(F.col("head") == 0, F.coalesce(F.col("c"), F.lit(0))).otherwise(0)
        sums = met.groupBy("doc_id", "h").agg(
            F.sum("head").alias("rows"),
            F.sum("n").alias("n"),
            F.sum(F.col("known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
            F.sum(F.col("known_log") + F.col("times") * F.log10(c + 1) * (1 - F.col("head"))).alias("logs"),
            F.sum("log").alias("log"),
        )
        each = sums.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
        share = lambda x: (F.col(x) / F.col("rows"))
        n_tokens = share("n").cast("long")
        return each.select(
            "doc_id",
            common.held_out(F.col("doc_id"), mod, rest).alias("held_out"),
            n_tokens.alias("n_tokens"),
            share("known").cast("long").alias("n_known"),
            F.lit(self.n).cast("long").alias("train_tokens"),
            (share("logs") - n_tokens * F.lit(float(np.log10(self.n + self.v + 1)))).alias("base_score"),
            (share("logs") + share("log")).alias("score"),
        )


_NAMES = ["doc_id", "h", "word", "times", "head", "n", "known", "known_log", "log"]
_ROW = "doc_id long, h long, word binary, times long, head int, n long, known long, known_log double, log double"
