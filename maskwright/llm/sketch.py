"""Count-min sketches with counters 0, 1 and "2 or more", built in tasks and merged block by block.

A sketch of ``ROWS`` rows and a power of two of cells a row never shows a repeated
key as single. Only its bits "at least so many" are gathered: ``MOST_CELLS``
bounds them, whatever the input; with more keys than cells the sketch lets more
single keys through, and the exact pass that follows sorts them out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2
LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 28
BLOCK = 1 << 18
_DENSE = BLOCK // 8
SCHEMA = "block int, once binary, more binary"


def cells_for(keys: int) -> int:
    """Cells a row for about so many keys."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, int(4 * keys - 1).bit_length())))


def places(keys: np.ndarray, cells: int, rows: int = ROWS) -> list[np.ndarray]:
    """The cell of each (well mixed) key in each row; rows lie one after another."""
    m = np.uint64(cells - 1)
    return [((keys >> np.uint64(29 * r)) & m).astype(np.int64) + r * cells for r in range(rows)]


def _pack(at: np.ndarray) -> bytes:
    if len(at) * 4 < _DENSE:
        return at.astype(np.uint32).tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _unpack(x: bytes) -> np.ndarray:
    if len(x) == _DENSE:
        return np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little"))
    return np.frombuffer(x, np.uint32)


def partial(keys: np.ndarray, cells: int, rows: int = ROWS) -> pa.RecordBatch:
    """The sketch of a task's keys, in blocks of SCHEMA."""
    at, n = np.unique(np.concatenate(places(keys, cells, rows)), return_counts=True)
    block = at // BLOCK
    starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1]) if len(at) else np.zeros(0, np.int64)
    ends = [*starts[1:], len(at)]
    number, once, more = [], [], []
    for a, b in zip(starts, ends, strict=False):
        number.append(int(block[a]))
        once.append(_pack(at[a:b] % BLOCK))
        more.append(_pack(at[a:b][n[a:b] > 1] % BLOCK))
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["block", "once", "more"])


def merge(parts: DataFrame, cells: int, least: int, rows: int = ROWS) -> np.ndarray:
    """Packed bits of all cells whose sum over tasks is at least ``least`` (1 or 2).

    Blocks are merged where they meet after one shuffle, read as a stream, so a task
    holds one block however many tasks made one.
    """

    def run(batches):
        now, counts = -1, np.zeros(BLOCK, np.uint8)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for block, once, more in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if block != now:
                    if now >= 0:
                        yield out()
                    now = block
                    counts[:] = 0
                at = _unpack(once)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[_unpack(more)] = 2
        if now >= 0:
            yield out()

    blocks = rows * cells // BLOCK
    n = min(blocks, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = np.zeros(rows * cells // 8, np.uint8)
    for r in parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary").toLocalIterator():
        bits[r.block * _DENSE : (r.block + 1) * _DENSE] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def holds(bits: np.ndarray, keys: np.ndarray, cells: int, rows: int = ROWS) -> np.ndarray:
    """Whether all rows have the key's bit."""
    out = np.ones(len(keys), bool)
    for at in places(keys, cells, rows):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out
