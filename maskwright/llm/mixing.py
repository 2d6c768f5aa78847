"""Mixing sources to target weights by entropy balancing.

Rates r of documents, at most ``MOST``, minimise sum(size * (r * log(r) - r)) subject to

* sum(size * r) = target for each source, and
* sum(size * r * z) = sum(size * r) * 0, z being the logarithm of a document's size less its
  mean over all words: the mix holds words of long and short documents as the input does.

The dual of this convex problem has one multiplier a source and one, ``tilt``, for the balance
of lengths (with a small ridge, as a balance may be out of reach). A document's rate is
min(MOST, exp(multiplier of its source + tilt * z)): an exponential tilt of its own. Newton's
steps need gradient and Hessian of the dual, sums over all documents; as documents of one source and
size are alike, they are counted once and every step sums over the counts, in the tasks. The Hessian
is diagonal but for one row, so that a step is a sum a source and two sums over the sources.
Rates are rounded to whole copies so that the rounding errors of a source cancel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A source's target, and each of its documents' copies, stop at so many times the input.
MOST = 3
#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (1.0, 2.0, 3.0)
#: Distinct documents of one rounding group, on average.
GROUP = 4000
#: Ridge of the tilt, as a share of all words, and its largest size.
RIDGE, TILT = 1e-3, 2.0
#: Steps in which the tilt moves too, and further ones for the sources' multipliers alone.
STEPS, SETTLE = 8, 6
#: Rows that one task makes of one repeated row.
CHUNK = 100_000
#: Sources whose table is small enough to be sent to every task.
SENT = 20_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def numbered(sums: DataFrame) -> DataFrame:
    """``sums`` with source_no, the place of each source in code-point order from 0, null last.

    Sorted by ranges, so no task sees them all; only a row count of each range reaches the driver.
    """
    rows = common.staged(sums.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    ranges, before = [], 0
    for k in sorted(sizes):
        ranges.append((k, before))
        before += sizes[k]
    offsets = rows.sparkSession.createDataFrame(ranges or [(0, 0)], "part long, before long")
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("source_no", F.col("before") + place).drop("at", "part", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources`` (source_size, source_no) with target: shares of all words by weight, none above
    ``most`` times its source, the excess reshared by weight until none is above.

    All sources below the cap take the same level of words a weight. The level only rises as
    sources reach their caps, so it is found by sums over the sources until it stays.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    left, mass = rows.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    total = left
    while mass:
        over = F.lit(left) * F.col("weight") / F.lit(mass) > F.col("cap")
        capped, free = rows.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if (total - capped, free) == (left, mass) or not free:
            break
        left, mass = total - capped, free
    share = F.lit(left or 0.0) * F.col("weight") / F.lit(mass or 1.0)
    return rows.withColumn("target", F.least(share, F.col("cap"))).drop("weight", "cap")


def _rate(x: Column) -> Column:
    return F.least(F.exp(F.least(x, F.lit(20.0))), F.lit(float(MOST)))


def _tilted(kinds: DataFrame, state: DataFrame, tilt: float) -> DataFrame:
    """``kinds`` (source_no, size, n, z) with the multiplier and rate of each, the sources' table sent out while it is small."""
    return kinds.join(state.select("source_no", "lambda"), "source_no").withColumn("x", F.col("lambda") + F.lit(tilt) * F.col("z")).withColumn("rate", _rate(F.col("x")))


def balance(kinds: DataFrame, sources: DataFrame, steps: int = STEPS, settle: int = SETTLE) -> tuple[DataFrame, float]:
    """(sources with lambda, tilt): the dual's solution by Newton's steps summed over ``kinds`` (source_no, size, n, z).

    ``sources`` has source_no, source_size and target. It starts at the multipliers without a tilt, log(target / size),
    which is the solution where nothing is tilted. A source at its cap has all its documents at the largest rate, and no multiplier
    moves it (log(MOST) and the tilt's span above); one without words or target takes none. In the last steps the tilt
    stands, so each source meets its own target.
    """
    capped = F.col("target") >= F.col("source_size") * F.lit(MOST * (1 - 1e-9))
    live = sources.where("source_size > 0 and target > 0")
    start = F.when(capped, F.lit(20.0)).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = common.staged(live.select("source_no", "source_size", "target", capped.alias("capped"), start.alias("lambda")), "multipliers")
    total = live.agg(F.sum("source_size")).first()[0] or 0
    small = state.count() <= SENT
    tilt, before, still = 0.0, None, False
    for step in range(steps + settle):
        sent = F.broadcast(state) if small else state
        words, inner = F.col("n") * F.col("size"), F.col("x") < float(np.log(MOST))
        flow = words * F.col("rate")
        per = _tilted(kinds, sent, tilt).groupBy("source_no").agg(
            F.sum(flow).alias("now"), F.sum(F.when(inner, flow).otherwise(0.0)).alias("d"), F.sum(F.when(inner, flow * F.col("z")).otherwise(0.0)).alias("c"),
            F.sum(flow * F.col("z")).alias("gz"), F.sum(F.when(inner, flow * F.col("z") * F.col("z")).otherwise(0.0)).alias("hz"),
        )
        per = common.staged(per.join(sent, "source_no"), "dual")
        free = ~F.col("capped") & (F.col("d") > 0)
        g = F.when(free, F.col("now") - F.col("target")).otherwise(0.0)
        ratio = F.when(free, F.col("c") / F.col("d")).otherwise(0.0)
        gz, hz, cross, fill, off = per.agg(F.sum("gz"), F.sum("hz"), F.sum(ratio * g), F.sum(ratio * F.col("c")), F.max(F.abs(g) / F.col("target"))).first()
        move = 0.0
        if step < steps and not still:
            grad, curve = (gz or 0.0) + RIDGE * total * tilt, (hz or 0.0) + RIDGE * total - (fill or 0.0)
            move = float(np.clip(-(grad - (cross or 0.0)) / max(curve, RIDGE * total), -0.5, 0.5)) if total else 0.0
            # a capped rate has no curvature: a step that turns back is halved
            move = move if before is None or move * before >= 0 else float(np.clip(move, -abs(before) / 2, abs(before) / 2))
            move = float(np.clip(tilt + move, -TILT, TILT)) - tilt
            before, still = move, abs(move) < 1e-5
        down = F.when(free, (-g - F.col("c") * F.lit(move)) / F.col("d")).otherwise(F.when(F.col("capped"), 0.0).otherwise(-0.5))
        state = per.select("source_no", "source_size", "target", "capped", (F.col("lambda") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), down))).alias("lambda"))
        tilt += move
        if still and (off or 0.0) < 1e-7:
            break
    return state, tilt


def copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(copies, more) near ``rate`` for documents that occur ``n`` times each: ``more`` of the n take one copy more.

    What a document takes too much or too little, those after it make up for, so with the
    largest first the whole is within half a small document of what is wanted.
    """
    low = np.minimum(most, np.floor(rate + 1e-9)).astype(np.int64)
    part = np.where(low >= most, 0.0, np.clip(rate - low, 0.0, 1.0))
    more = np.zeros(len(size), np.int64)
    owed = 0.0
    for i, (words, times, p) in enumerate(zip(size.tolist(), n.tolist(), part.tolist(), strict=True)):
        owed += p * words * times
        if p and words:
            more[i] = min(times, max(0, int(owed / words + 0.5)))
            owed -= more[i] * words
    return low, more


def _rounded(docs: DataFrame, weights: tuple[float, ...], group: int) -> DataFrame:
    """(source, doc_id, h, size, n, source_size, target, copies, more) of the distinct documents: all alike rows are one of n."""
    size = word_count(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("h"))
    each = common.staged(rows.groupBy("source", "doc_id", "h", "size").agg(F.count(F.lit(1)).alias("n")), "kinds")
    sums = each.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = common.staged(targets(numbered(sums), weights), "targets").withColumnRenamed("source", "s_source")
    small = sources.count() <= SENT
    told = each.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    log = F.log(F.greatest(F.col("size"), F.lit(1)))
    alike = told.groupBy("source_no", "size").agg(F.sum("n").alias("n"))
    words, mass = alike.agg(F.sum(F.col("size") * F.col("n")), F.sum(F.col("size") * F.col("n") * log)).first()
    centre = float(mass / words) if words else 0.0
    z = log - F.lit(centre)
    state, tilt = balance(common.staged(alike.withColumn("z", z), "alike"), sources)
    state = state.select("source_no", "lambda")
    told = told.join(F.broadcast(state) if small else state, "source_no", "left")
    rate = F.coalesce(_rate(F.col("lambda") + F.lit(tilt) * z), F.lit(0.0))
    spread = F.pmod(F.xxhash64("doc_id", "h"), F.greatest(F.lit(1), F.ceil(F.col("docs") / group))).cast("int")
    kinds = {f.name: f.dataType.simpleString() for f in each.schema.fields}
    cols = ["source", "doc_id", "h", "size", "n", "source_size", "target"]
    schema = ", ".join(f"{c} {kinds.get(c, 'long' if c == 'source_size' else 'double')}" for c in cols) + ", copies long, more long"

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "id_hash"], ascending=[False, True, True], kind="stable")
        low, more = copies(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy())
        return pdf[cols].assign(copies=low, more=more)

    groups = told.withColumn("rate", rate).withColumn("g", spread).withColumn("id_hash", F.xxhash64("doc_id"))
    return groups.select(*cols, "rate", "source_no", "g", "id_hash").groupBy("source_no", "g").applyInPandas(rounded, schema)


def _each(kinds: DataFrame, times: Column, name: str) -> DataFrame:
    """``kinds`` as often as ``times`` says, numbered from 0: in chunks that are dealt out before they are unfolded."""
    pieces = kinds.withColumn("_times", times).where("_times > 0").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_times - 1) div {CHUNK} as int)"))))
    hot = pieces.where(f"_times > {CHUNK}").repartition("doc_id", "h", "_piece")
    out = pieces.where(f"_times <= {CHUNK}").unionByName(hot)
    first = F.col("_piece").cast("long") * CHUNK
    return out.withColumn(name, F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_times")) - 1))).drop("_times", "_piece")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, group: int = GROUP) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row, and copies (taken = copies * size).

    Null texts have size 0. Rows alike in doc_id, text and source are counted as one document that occurs n times: some
    of them take a copy more than others, and as they are alike it doesn't matter which. No
    text is shuffled, and no source, size or repeated row meets in one task.
    """
    each = _each(_rounded(docs, weights, group), F.col("n"), "_k").withColumn("copies", F.col("copies") + (F.col("_k") < F.col("more")).cast("long"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, group: int = GROUP) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies, with copy_no from 1.

    Rows alike in doc_id, text and source stand for each other: one of them comes as often as all together are taken.
    Texts meet their copies in one join by (doc_id, text hash), whose skewed keys the join may split.
    """
    names = docs.columns
    key = ["source", "doc_id", "h"]
    made = _rounded(docs, weights, group).withColumn("total", F.col("copies") * F.col("n") + F.col("more")).where("total > 0")
    made = common.staged(made.select(*(F.col(c).alias(f"_{c}") for c in key), "n", "total"), "copies")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), *[F.col(f"`{c}`").alias(f"_col{i}") for i, c in enumerate(names)])
    met = rows.join(made, F.expr(" and ".join(f"{c} <=> _{c}" for c in key))).drop(*(f"_{c}" for c in key))
    met = met.where("n = 1").unionByName(met.where("n > 1").dropDuplicates(key))
    out = _each(met, F.col("total"), "_k")
    return out.select(*[F.col(f"_col{i}").alias(c) for i, c in enumerate(names)], (F.col("_k") + 1).cast("int").alias("copy_no"))
