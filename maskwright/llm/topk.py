"""Exact top-k inner-product search: columnar branch and bound.

Candidates are held dimension by dimension (vertical layout). Partial scores grow
block of dimensions by block; after each block a pair of query and candidate survives only if
its partial score plus the most that the remaining dimensions can add (the product
of the remaining norms) can still reach the query's k-th best score so far. The first
block is one dense product for all queries; from then on only the surviving pairs are held.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Queries of one pass: what is sent to the executors at once is bounded by this.
QUERY_BLOCK = 4096
#: Candidates that meet all queries of a block at once: with the block this bounds the dense product.
BATCH = 512
#: Dimensions of one step.
STEP = 16
_EXACT = float(1 << 52)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(1024 * x); rows with null vectors, null or
    non-finite components are left out. Repeated rows all stay: each is a candidate, and a query, of its own."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    good = vectors.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * 1024).cast("long")).alias("v"))


class Block:
    """The queries of one length: their vectors, ordered so that heavy dimensions come first."""

    def __init__(self, rows: list[tuple[int, int, list[int]]]):
        self.number = np.array([r[0] for r in rows], np.int64)
        self.vec_id = np.array([r[1] for r in rows], np.int64)
        q = np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1)
        self.order = np.argsort(-(q**2).sum(0), kind="stable")
        self.q = q[:, self.order]
        self.whole = [r[2] for r in rows]
        self.cuts = [*range(0, q.shape[1], STEP), q.shape[1]] if q.shape[1] else [0, 0]
        self.rest = np.stack([np.sqrt((self.q[:, c:] ** 2).sum(1)) for c in self.cuts[1:]]) if len(rows) else np.zeros((0, 0))
        self.most = float(np.abs(q).max(initial=0))
        self.score = np.zeros(0, np.int64)  # the best so far, by query and rank
        self.ids = np.zeros(0, np.int64)
        self.of = np.zeros(0, np.int64)

    def floors(self, k: int) -> np.ndarray:
        """Each query's k-th best score so far; minus infinity while it has fewer."""
        out = np.full(len(self.number), -np.inf)
        n = np.bincount(self.of, minlength=len(out))
        last = np.cumsum(n) - 1
        full = n >= k
        out[full] = self.score[last[full]]
        return out

    def feed(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        """Meet a batch of candidates; ids that are null come as the largest long and lose ties."""
        if v.shape[1] * self.most * float(np.abs(v).max(initial=0)) >= _EXACT:
            return self._feed_plain(ids, v, k)
        for at in range(0, len(ids), BATCH):
            self._feed_batch(ids[at : at + BATCH], v[at : at + BATCH], k)

    def _feed_batch(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        columns = np.ascontiguousarray(v.T[self.order].astype(np.float64))
        rest = [np.sqrt((columns[c:] ** 2).sum(0)) for c in self.cuts[1:]]
        floor = self.floors(k)
        dense = self.q[:, : self.cuts[1]] @ columns[: self.cuts[1]]
        slack = np.outer(self.rest[0], rest[0])
        other = ids[None, :] != self.vec_id[:, None]
        if dense.shape[1] >= k:  # k others surely reach this much
            floor = np.maximum(floor, np.partition(np.where(other, dense - slack, -np.inf), -k, axis=1)[:, -k] - 1e-3)
        # a bound of rounding keeps ties and near ties
        i, j = np.nonzero((dense + slack * (1 + 1e-9) + 1e-3 >= floor[:, None]) & other)
        part = dense[i, j]
        for step in range(1, len(self.cuts) - 1):
            a, b = self.cuts[step : step + 2]
            for d in range(a, b):
                part = part + self.q[i, d] * columns[d, j]
            live = part + self.rest[step][i] * rest[step][j] * (1 + 1e-9) + 1e-3 >= floor[i]
            i, j, part = i[live], j[live], part[live]
        self._take(i, ids[j], np.rint(part).astype(np.int64), k)

    def _feed_plain(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        """Components too large for exact doubles: whole numbers of any size, held to the range of a long."""
        w = v.astype(object)
        for i in range(len(self.number)):
            s = w @ np.array(self.whole[i], object) if w.shape[1] else np.zeros(len(ids), object)
            self._take(np.full(len(ids), i), ids, np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in s], np.int64), k)

    def _take(self, of: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> None:
        """Merge new pairs into the best, rows with the query's own id aside."""
        other = ids != self.vec_id[of]
        of, ids, score = (np.concatenate([old, new[other]]) for old, new in ((self.of, of), (self.ids, ids), (self.score, score)))
        at = np.lexsort((ids, ~score, of))  # ~ reverses the order of all longs, the least too
        of = of[at]
        place = np.arange(len(of)) - np.searchsorted(of, of, "left")
        best = place < k
        self.of, self.ids, self.score = of[best], ids[at][best], score[at][best]


_OUT = "query int, vec_id long, score long"
_NULL = np.iinfo(np.int64).max


def search(candidates: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller id.

    Both sides have columns vec_id and v. A query meets candidates of its own length
    only, and never a row with its own id; repeated query rows each have their answer. Queries are numbered and taken in blocks
    of ``query_block``; each block is sent to the executors and all candidates are read
    against it in place, so candidates are not shuffled. The answers of a block are written before
    the next block is sent, so only one is held at a time. A query without candidates has no rows.
    """
    spark = candidates.sparkSession
    known = queries.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v")
    block, out = [], []

    def run(rows, last: bool):
        numbers = {i: r[0] for i, r in enumerate(rows)}
        sent = spark.sparkContext.broadcast([(i, vid, v) for i, (vid, v) in enumerate(rows)])

        def best(batches):
            by_length: dict[int, list] = {}
            for r in sent.value:
                by_length.setdefault(len(r[2]), []).append(r)
            blocks = {n: Block(rows) for n, rows in by_length.items()}
            for b in batches:
                column = b.column("v")
                sizes = np.diff(column.offsets.to_numpy())
                flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
                ids = np.array(b.column("vec_id").fill_null(_NULL).to_numpy(zero_copy_only=False))
                for n, block in blocks.items():
                    at = np.flatnonzero(sizes == n)
                    if len(at):
                        block.feed(ids[at], flat[starts[at][:, None] + np.arange(n)].reshape(len(at), n), k)
            for block in blocks.values():
                yield pa.RecordBatch.from_arrays([pa.array(block.number[block.of], pa.int32()), pa.array(block.ids, pa.int64(), mask=block.ids == _NULL), pa.array(block.score, pa.int64())], ["query", "vec_id", "score"])

        top = candidates.select("vec_id", "v").mapInArrow(best, _OUT)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        ranked = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(numbers.items()) or [(0, 0)], "query int, query_id long")
        found = ranked.join(F.broadcast(ids), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if last and not out:
            return found
        found = common.staged(found, "top")
        sent.unpersist()
        return found

    for r in known.toLocalIterator():
        if len(block) == query_block:
            out.append(run(block, False))
            block = []
        block.append((r.vec_id, list(r.v)))
    out.append(run(block, True))
    return reduce(DataFrame.unionByName, out)
