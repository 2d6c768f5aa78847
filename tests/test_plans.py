"""Shapes of plans that the engine's cost hangs on."""

import re

from pyspark.sql import functions as F

from maskwright.operators import detect, engine, payload, registry, tokenise
from maskwright.plans import detection, lifecycle, measures
from maskwright.session import settled, spread, table

from .conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    p = plan(detection.email_class_counts(spark, SMALL))
    assert re.search(r"ReadSchema: struct<text:string,lang:string>", p) and "Python" not in p and "Arrow" not in p


def test_filters_reach_the_scan(spark):
    assert "StringContains(text,@)" in plan(detection.email_spans(spark, SMALL))
    table = spark.read.parquet(f"{SMALL}/orders.parquet").withColumnRenamed("o_orderdate", "last_used_at")
    assert "GreaterThanOrEqual(o_orderdate" in plan(registry.purged(table, F.lit("2024-01-01").cast("timestamp")))


def test_detection_runs_once(spark):
    """The planner must not push a filter on spans below them, which would find them twice."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("text"))
    p = plan(tokenise.class_counts(docs.select(detect.emails(F.col("text")).alias("spans"))))
    assert p.count("regexp_extract_all") == p.split("AdaptiveSparkPlan")[-1].count("regexp_extract_all") and "Filter (size" not in p and "(size(CASE" not in p


def test_counts_combine_before_they_shuffle(spark):
    p = plan(detection.email_class_counts(spark, SMALL))
    assert p.count("Exchange") == 1 and "partial_count" in p


def test_small_sides_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan(lifecycle.dictionary_lookup(spark, SMALL))
    assert "CartesianProduct" not in plan(measures.dictionary_linkage(spark, SMALL))


def test_small_tables_are_spread_and_others_are_not(spark):
    """One file of one row group is dealt over the cores; a table whose size fills them stays where it lies."""
    docs = table(spark, SMALL, "documents")
    cores = spark.sparkContext.defaultParallelism
    assert "RoundRobinPartitioning" in plan(spread(docs.select("text"), docs)) or cores == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Exchange" not in plan(spread(docs.select("text"), docs))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sides_as_large_as_the_corpus_are_not_broadcast(spark):
    """A small file can hold a large table: texts, bodies and what was settled are never sent through the driver on an estimate."""
    ids = table(spark, SMALL, "customer").select(F.col("c_custkey").alias("doc_id"))
    assert settled(ids)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40
    texts = ids.select("doc_id", F.lit("почта a@b.ru").alias("text"))
    for done in (engine.detect(texts), engine.protect(texts, b"k" * 32).texts, payload.put_back(texts, settled(texts.withColumn("path", F.lit("$"))), "text", "doc_id")):
        assert "BroadcastHashJoin" not in plan(done)
