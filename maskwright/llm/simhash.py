"""SimHash near-duplicates, found exactly through vantage-point trees.

Fingerprints within ``REACH`` bits of each other agree to within REACH // BANDS bits
in at least one of ``BANDS`` equal bands (pigeonhole), and on a band the Hamming
distance is a metric. For each band a vantage-point tree, built from a bounded
sample, splits its space by the distance to vantage points; its leaves are the
shards. A fingerprint lies in one shard of each band and asks all shards that the
triangle bound cannot rule out for its ball: those of both sides where its distance
is within the reach of the boundary. Within a shard pairs are found by sorting parts of
the fingerprints, and only a spanning forest of the links is handed on, never all pairs.

For similarities as low as 0.8 the reach is too wide for any triangle bound to prune.
``similar`` then takes longer fingerprints and trees over random bits, each fingerprint
asking its own shard of each tree only. Unlike the exact search this finds a pair with a
probability; trees are added until it is close to one at any size (``MISS``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .windows import mix

BITS = 64
#: Fingerprints link at so many differing bits or fewer.
REACH = 4
#: Bands of a fingerprint: REACH // BANDS differing bits in one of them are what a pair within reach can't avoid.
BANDS = 4
#: Fingerprints that a shard should hold, and those from which the trees are built, about.
SHARD, SAMPLE = 4096, 100_000
#: Leaves up to which the table of large shards is surely small enough to be sent out.
LEAVES_SENT = 200_000
#: Wide fingerprints for similarities: their words, the bits of each tree, and the fingerprints of a shard.
WORDS, TREE_BITS, WIDE_SHARD = 8, 16, 300
#: Candidates differ in a deviation times SLACK more bits than expected at the least similarity.
SLACK = 2
#: Trees are added until a pair at the least similarity, a deviation and a quarter worse than expected, meets in none with this probability.
MISS = 0.01
#: Widths up to which a tree keeps the leaf of every value, for points that ask for their own leaf only.
TABLE_BITS = 16
#: A shard that the sample shows to hold more than so many is dealt to several tasks, each with a part of it.
PART = 20_000


def fingerprint(text: str | None, size: int = 4) -> int:
    """The text's fingerprint: bits that are set in over half of its shingles' XXH64 (seed 42), as unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    h = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    hashes = np.fromiter((h(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits((total * 2 > n).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and f, the fingerprint as a signed long, for each row."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(b.column("text")[i].as_py(), size) for i in range(len(b))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(f.view(np.int64), pa.int64())], [*keep, "f"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", f long")


class Tree:
    """A vantage-point tree over the values of one band. Leaves are numbered; boundaries hold for any value, sampled or not."""

    def __init__(self, values: np.ndarray, reach: int, leaf: float, seed: int, width: int = BITS):
        self.reach, self.width, self.table = reach, width, None
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, inside, outside; leaves have vantage -1 and their number
        self.leaves, self.sampled = 0, len(values)
        #: Sampled values in each leaf.
        self.sizes: list[int] = []
        self.root = self._grow(values, leaf, np.random.default_rng(seed))
        if width <= TABLE_BITS:  # the leaf of every value there can be
            i, at = self.visit(np.arange(1 << width, dtype=np.uint64), 0)
            self.table = np.empty(1 << width, np.int32)
            self.table[i] = at

    def _grow(self, p: np.ndarray, leaf: float, rng) -> int:
        kinds = np.unique(p)
        if len(p) <= leaf or len(kinds) < 2:
            self.nodes.append((-1, self.leaves, 0, 0))
            self.sizes.append(len(p))
            self.leaves += 1
            return len(self.nodes) - 1
        best = None
        for v in rng.choice(kinds, min(8 if self.reach else 2, len(kinds)), replace=False):  # the vantage point whose boundary fewest balls cross
            d = np.bitwise_count(p ^ v).astype(np.int64)
            counts = np.bincount(d, minlength=65)
            below = np.concatenate(([0], np.cumsum(counts)))
            r = np.arange(64)
            small = np.minimum(below[r + 1], len(p) - below[r + 1])
            cross = below[np.minimum(r + self.reach + 1, 65)] - below[np.maximum(0, r - self.reach + 1)]
            score = np.where(small * 5 >= len(p), cross / len(p) - small / len(p), np.inf)
            at = int(score.argmin())
            if score[at] < (np.inf if best is None else best[0]):
                best = (score[at], int(v), at, d)
        if best is None:
            v = kinds[0]
            d = np.bitwise_count(p ^ v).astype(np.int64)
            best = (0, int(v), int(np.median(d)) if d.max() > np.median(d) else int(d.max()) - 1, d)
        _, v, r, d = best
        at = len(self.nodes)
        self.nodes.append((v, r, 0, 0))
        inside, outside = self._grow(p[d <= r], leaf, rng), self._grow(p[d > r], leaf, rng)
        self.nodes[at] = (v, r, inside, outside)
        return at

    def visit(self, p: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of a value, leaf) for all leaves that its ball of radius ``reach`` may touch.

        At a node with vantage point v and radius r, a ball around p lies wholly inside if
        d(p, v) <= r - reach and wholly outside if d(p, v) > r + reach (triangle bound): the other
        branch is pruned. A ball across the boundary goes down both. ``pruned`` counts branches not taken.
        """
        if self.table is not None and not reach:
            return np.arange(len(p)), self.table[p]
        out_i, out_leaf = [], []
        self.pruned = 0
        stack = [(self.root, np.arange(len(p)))]
        while stack:
            at, i = stack.pop()
            if not len(i):
                continue
            v, r, inside, outside = self.nodes[at]
            if v < 0:
                out_i.append(i)
                out_leaf.append(np.full(len(i), r, np.int32))
                continue
            d = np.bitwise_count(p[i] ^ np.uint64(v)).astype(np.int64)
            near, far = i[d <= r + reach], i[d > r - reach]
            self.pruned += 2 * len(i) - len(near) - len(far)
            stack += [(inside, near), (outside, far)]
        return np.concatenate(out_i) if out_i else np.zeros(0, np.int64), np.concatenate(out_leaf) if out_leaf else np.zeros(0, np.int32)


def _equal_in_a_part(points: np.ndarray, own: np.ndarray, reach: int, cells: int):
    """(x, y) places of points and of own points that agree wholly in one of reach + 1 parts of their 64 bits.

    Any pair within ``reach`` bits does (pigeonhole), so a shard's pairs are found by sorting, not by comparing all.
    """
    cuts = [BITS * k // (reach + 1) for k in range(reach + 2)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = (points >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        mine = own[np.argsort(part[own], kind="stable")]
        keys = part[mine]
        first, last = np.searchsorted(keys, part, "left"), np.searchsorted(keys, part, "right")
        total = np.cumsum(last - first)
        at = 0
        while at < len(points):  # so many pairs at once; a single point with more goes alone
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + cells, "right")))
            n = (last - first)[at:end]
            x = np.repeat(np.arange(at, end), n)
            yield x, mine[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:end], n)]
            at = end


def forest(points: np.ndarray, own: np.ndarray, reach: int, cells: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links between a shard's own points and all of ``points`` (64-bit fingerprints), as stars:
    the places of each linked point and of its group's first."""
    root = np.arange(len(points))
    for x, y in _equal_in_a_part(points, np.flatnonzero(own), reach, cells):
        apart = root[x] != root[y]  # pairs joined through others need no look
        x, y = x[apart], y[apart]
        near = np.bitwise_count(points[x] ^ points[y]) <= reach
        x, y = x[near], y[near]
        while True:
            p, q = root[x], root[y]
            apart = p != q
            if not apart.any():
                break
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root != root[root]).any():
                root = root[root]
    far = np.flatnonzero(root != np.arange(len(points)))
    return far, root[far]


def closest_forest(x: np.ndarray, y: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the pairs (x, y, at distance d) that make a spanning forest of ``n`` points with the closest pairs."""
    root = np.arange(n)
    kept = []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        while True:
            p, q = root[x[at]], root[y[at]]
            at = at[p != q]
            if not len(at):
                break
            high, low = np.maximum(root[x[at]], root[y[at]]), np.minimum(root[x[at]], root[y[at]])
            order = np.lexsort((low, high))
            first = order[np.unique(high[order], return_index=True)[1]]
            kept.append(at[first])
            root[high[first]] = low[first]
            while (root != root[root]).any():
                root = root[root]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def candidates(points: np.ndarray, own: np.ndarray, group: np.ndarray, reach: int, every: bool, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shard's own points and all of ``points`` within ``reach`` bits and of different groups.

    Unless ``every``, only those of a forest of the closest ones: whatever lies within reach of each other is joined through
    pairs at most as far apart, and a group of n copies gives n - 1 pairs.
    """
    a = np.flatnonzero(own)
    words = np.ascontiguousarray(points.T)
    out = tuple(np.zeros(0, np.int64) for _ in range(3))
    step = max(1, cells // max(1, len(a)))
    for at in range(0, len(points), step):
        d = np.bitwise_count(words[0, at : at + step, None] ^ words[0, a][None, :]).astype(np.uint16)
        for w in words[1:]:
            d += np.bitwise_count(w[at : at + step, None] ^ w[a][None, :])
        x, y = np.nonzero(d <= reach)
        far = d[x, y].astype(np.int64)
        x, y = x + at, a[y]
        new = (group[x] != group[y]) & ((x < y) | ~own[x])
        out = tuple(np.concatenate([old, c[new]]) for old, c in zip(out, (x, y, far), strict=True))
        if not every:
            kept = closest_forest(*out, len(points))
            out = tuple(c[kept] for c in out)
    return out[0], out[1]


def _meet(found: DataFrame, values, trees: list[Tree], reach: int, band_reach: int, n: int, every: bool | None = None) -> DataFrame:
    """a, b: links found by dealing ``found`` to the leaves of ``trees``.

    ``values(words, k)`` gives the band values of tree k. A fingerprint is f itself, or where
    there is a column w, that holds its words as bytes and f is its number. With ``every``
    the pairs are those of ``candidates``, with a < b; a column g has the groups. ``n`` is the number of fingerprints: a
    leaf that the sample shows to be large is dealt in parts.
    """
    sent = found.sparkSession.sparkContext.broadcast(trees)
    wide = [c for c in ("w", "g") if c in found.columns]

    def words_of(f, raw) -> np.ndarray:
        return np.frombuffer(b"".join(raw), np.uint64).reshape(len(f), -1) if wide else np.ascontiguousarray(f).view(np.uint64).reshape(-1, 1)

    def dealt(batches):
        for b in batches:
            f = b.column("f")
            words = words_of(f.to_numpy(zero_copy_only=False), b.column("w").to_pylist() if wide else ())
            for k, tree in enumerate(sent.value):
                v = values(words, k)
                home_i, home = tree.visit(v, 0)
                own = np.empty(len(f), np.int32)
                own[home_i] = home
                i, leaf = tree.visit(v, band_reach) if band_reach else (home_i, home)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(leaf), pa.array(own[i] == leaf), f.take(at), *(b.column(c).take(at) for c in wide)], ["tree", "leaf", "home", "f", *wide])

    rows = found.select("f", *wide).mapInArrow(dealt, "tree int, leaf int, home boolean, f long" + "".join({"w": ", w binary", "g": ", g long"}[c] for c in wide))
    large = [(k, leaf, int(np.ceil(size * n / max(1, tree.sampled) / PART))) for k, tree in enumerate(trees) for leaf, size in enumerate(tree.sizes) if size * n > PART * tree.sampled]
    parts = found.sparkSession.createDataFrame(large or [(-1, 0, 1)], "tree int, leaf int, parts int")
    rows = rows.join(F.broadcast(parts) if len(large) < LEAVES_SENT else parts, ["tree", "leaf"], "left")
    # a large shard's own fingerprints are split into parts, and each part meets all that ask
    dealt_in = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("own_part", F.when(F.col("home"), F.pmod(F.xxhash64("f"), dealt_in).cast("int"))).withColumn("part", F.explode(F.sequence(F.lit(0), dealt_in - 1)))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["f"].to_numpy()
        a, b = forest(np.ascontiguousarray(f).view(np.uint64), (pdf["own_part"] == pdf["part"]).to_numpy(), reach)
        return pd.DataFrame({"a": f[a], "b": f[b]})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("f")  # so that forests of different shards agree
        f = pdf["f"].to_numpy()
        a, b = candidates(words_of(f, pdf["w"]), (pdf["own_part"] == pdf["part"]).to_numpy(), (pdf["g"] if "g" in wide else pdf["f"]).to_numpy(), reach, every)
        return pd.DataFrame({"a": np.minimum(f[a], f[b]), "b": np.maximum(f[a], f[b])})

    rows = rows.select("tree", "leaf", "part", "own_part", "f", *wide).groupBy("tree", "leaf", "part")
    return rows.applyInPandas(meet if every is None else pairs, "a long, b long")


def _sample(found: DataFrame, n: int) -> np.ndarray:
    """Words of about SAMPLE fingerprints, drawn by hash: the trees' shape hangs on them, the result doesn't."""
    some = found.where(common.share_of(F.xxhash64("f"), n, SAMPLE)).orderBy("f")
    if "w" not in found.columns:
        return np.array([r.f for r in some.toLocalIterator()], np.int64).view(np.uint64).reshape(-1, 1)
    rows = [bytes(r.w) for r in some.toLocalIterator()]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint64)


def links(found: DataFrame, reach: int = REACH, shard: int = SHARD) -> DataFrame:
    """a, b: links among the distinct fingerprints ``found`` (f), enough to join all that are within ``reach`` bits through others."""
    n = found.count()
    width, band_reach = BITS // BANDS, reach // BANDS
    mask = np.uint64((1 << width) - 1)
    values = lambda words, k: (words[:, 0] >> np.uint64(k * width)) & mask
    points = _sample(found, n)
    return _meet(found, values, [Tree(values(points, k), band_reach, shard * len(points) / max(1, n), k, width) for k in range(BANDS)], reach, band_reach, n)


def classes(found: DataFrame, reach: int = REACH) -> DataFrame:
    """f, component_id for rows (f, doc_id): the least doc_id among all fingerprints reachable from f.

    Null ids count for nothing; a component of them alone has a null id.
    """
    kinds = common.staged(found.groupBy("f").agg(F.min("doc_id").alias("least")), "fingerprints")
    named, ids = _named(kinds, links(kinds.select("f"), reach))
    return named.join(ids, "root").select("f", "component_id")


def _named(kinds: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(f, root) of ``kinds`` (f, least) linked by ``found``, and (root, component_id): the least ``least`` of each root.

    Both are written, so that joining them broadcasts the ids while they are small and may split a skewed root beyond.
    """
    roots = components(found)
    named = kinds.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    named = common.staged(named, "named")
    return named.select("f", "root"), common.staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")


def near_duplicates(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint, component_id for each row; null or empty texts have fingerprint zero.

    Copies are one fingerprint; skewed fingerprints are split by the join back to rows.
    """
    rows = common.staged(fingerprints(docs), "rows")
    named = common.staged(classes(rows, reach), "classes")
    return rows.join(named, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; of a shorter text the hash of all its words."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    flat = b" ".join(w)
    if len(w) <= size:
        return np.array([xxhash.xxh3_64_intdigest(flat)], np.uint64)
    lengths = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(flat[a:b]) for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(w) - size + 1))


def wide_fingerprint(h: np.ndarray, words: int = WORDS) -> bytes:
    """A SimHash of 64 * ``words`` bits over a set of shingles."""
    out = []
    for k in range(words):
        x = mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        total = np.zeros(BITS, np.int64)
        for at in range(0, len(x), 8192):
            total += np.unpackbits(x[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits((total * 2 > len(h)).astype(np.uint8)).tobytes())
    return b"".join(out)


def similar_reach(similarity: float, bits: int, slack: float = 1.25) -> int:
    """Differing bits expected of two shingle sets of equal size with this Jaccard similarity, and a deviation times ``slack`` more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(round(bits * p + slack * (bits * p * (1 - p)) ** 0.5))


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` without near copies: of each group linked by similar word shingles, the row with the least doc_id stays.

    Ties (repeated rows, null ids, which come last) go by text hash, and one of equal rows
    stays. Texts without words are copies of each other. All columns stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("d"), F.xxhash64("text").alias("h"))

    def run(batches):
        for b in batches:
            sets = [shingles(x.as_py(), size) for x in b.column("text")]
            f = np.array([xxhash.xxh3_64_intdigest(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("d"), b.column("h"), pa.array(f), pa.array([wide_fingerprint(h) for h in sets], pa.binary())], ["n", "d", "h", "f", "w"])

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("f"), pa.array([shingles(x.as_py(), size).tobytes() for x in b.column("text")], pa.binary())], ["f", "s"])

    texts = docs.select(key.alias("k"), "text").select("k.*", "text")
    each = common.staged(texts.mapInArrow(run, "n boolean, d long, h long, f long, w binary"), "wide")
    # f stands for the set of shingles: texts with the same set are one
    kinds = common.staged(each.groupBy("f").agg(F.min(F.struct("n", "d", "h")).alias("least"), F.min("w").alias("w")), "kinds")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with ok: whether the shingle sets of both are similar."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("f")).distinct()
        asked = kinds.join(ids, "f", "left_semi").select("f", "least.*")
        sets = common.staged(texts.join(asked, ["n", "d", "h"]).select("f", "text").dropDuplicates(["f"]).mapInArrow(hashed, "f long, s binary"), "sets")
        both = pairs.join(sets.select(F.col("f").alias("a"), F.col("s").alias("s")), "a").join(sets.select(F.col("f").alias("b"), F.col("s").alias("t")), "b")

        def check(batches):
            for b in batches:
                ok = [alike(x.as_py(), y.as_py(), similarity) for x, y in zip(b.column("s"), b.column("t"), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

        return common.staged(both.mapInArrow(check, "a long, b long, ok boolean"), "confirmed")

    _, ids = _named(kinds.select("f", "least"), _similar(kinds.select("f", "w"), similarity, confirmed))
    winners = ids.select("component_id.*")
    rows = docs.select(key.alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("k.*", "row")
    won = rows.join(winners, ["n", "d", "h"], "left_semi").dropDuplicates(["n", "d", "h"])
    return won.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def alike(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sorted shingle sets have this Jaccard similarity or more."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) * (1 - 1e-12):
        return False
    common_ = len(a) + len(b) - len(np.union1d(a, b))
    return common_ >= similarity * (len(a) + len(b) - common_) * (1 - 1e-12)


def _similar(found: DataFrame, similarity: float, confirmed) -> DataFrame:
    """a, b: links that ``confirmed`` finds true, enough to join all candidates that it would find true.

    The first pass takes a forest of the closest candidates of each shard, so their number grows with the
    fingerprints and not with the square of a group. A pair that is similar is joined in it through pairs at most as far apart. Where
    one of these proves wrong, a second pass takes all pairs around it that true links have not joined yet.
    """
    n = found.count()
    trees, values = _wide_trees(_sample(found, n), n, similarity)
    reach = similar_reach(similarity, 64 * WORDS, SLACK)
    pairs = _meet(found, values, trees, reach, 0, n, False).distinct()
    first = confirmed(common.staged(pairs, "pairs"))
    true = first.where("ok").select("a", "b")
    if first.where("not ok").isEmpty():
        return true
    near = components(first.select("a", "b"))
    wrong = near.join(first.where("not ok").select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct()
    again = near.join(wrong, "root", "left_semi").select(F.col("node").alias("f"))
    groups = components(true)
    again = found.join(again, "f").join(groups.withColumnRenamed("node", "f"), "f", "left").select("f", "w", F.coalesce("root", "f").alias("g"))
    pairs = _meet(common.staged(again, "again"), values, trees, reach, 0, n, True).distinct()
    pairs = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = confirmed(common.staged(pairs, "pairs"))
    return true.unionByName(second.where("ok").select("a", "b"))


def _wide_trees(points: np.ndarray, n: int, similarity: float):
    """Trees for ``n`` wide fingerprints by a sample of them, and values(words, k) of tree k.

    The deeper the trees, the more of them: the share of the sample's values that stay in
    their leaf when each bit flips as often as in a pair at ``similarity`` tells what a tree
    misses. As a tree sees TREE_BITS bits only, that share has a floor, and the trees end.
    """
    bits = 64 * WORDS
    flips = similar_reach(similarity, bits) / bits
    rng = np.random.default_rng(11)
    powers = np.uint64(1) << np.arange(TREE_BITS, dtype=np.uint64)
    picked, trees = [], []

    def values(words: np.ndarray, k: int) -> np.ndarray:
        at = picked[k].astype(np.uint64)
        return (((words[:, (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)) * powers).sum(1, dtype=np.uint64)

    missed = 1.0
    while len(points) and missed > MISS:
        picked.append(np.sort(rng.choice(bits, TREE_BITS, replace=False)))
        v = values(points, len(trees))
        trees.append(Tree(v, 0, WIDE_SHARD * len(points) / max(1, n), len(trees), TREE_BITS))
        asked = np.resize(v, max(20_000, len(v)))
        flipped = asked ^ ((rng.random((len(asked), TREE_BITS)) < flips) * powers).sum(1, dtype=np.uint64)
        missed *= 1 - float((trees[-1].table[asked] == trees[-1].table[flipped]).mean())
    return trees, values
