"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the ASCII controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="maskwright-")
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, so a
    lost executor costs its running tasks only. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_remove_staged)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_staged() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone: the cluster clears its checkpoint folder
            return


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def share_of(h: Column, rows: int, most: int) -> Column:
    """Whether a hash lies in the share that holds about ``most`` of so many rows (all, if fewer)."""
    return F.lit(True) if rows <= most else F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * most / rows)


def label_sample(labels: DataFrame, label: str, mod: int, rest: int, per_class: int) -> DataFrame:
    """About ``per_class`` labelled ids of each class (all, if fewer), drawn by hash, none of them held out.

    Ids whose labels disagree, and null ids or labels, teach nothing and are left out.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
        .groupBy("doc_id")
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .where("lo = hi and lo in (0, 1)")
        .select("doc_id", F.col("lo").cast("int").alias("label"))
    )
    n = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    chosen = [(F.col("label") == k) & share_of(F.xxhash64("doc_id"), n.get(k, 0), per_class) for k in (0, 1)]
    return one.where(chosen[0] | chosen[1])
