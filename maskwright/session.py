"""Session defaults and table access shared by queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maskwright")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, made from the files of ``source`` for costly work on each row, dealt over all cores if the scan has fewer tasks: a file of one
    row group is one task. A table that fills the cores by its files or its size is not shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(source._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return df.repartition(cores) if len(source.inputFiles()) < cores and size < cores * most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only a session on one machine may do without: it gets one of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="maskwright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read from there: used where more than one plan reads it, and by iterations.

    Its size counts as unknown. A checkpoint keeps the planner's estimate of what made it, which falls short by orders of magnitude for texts and
    lists made from a small file, and what looks small is broadcast through the driver. Joins of unknown sizes are shuffled; adaptive execution
    still broadcasts a side that turns out small.
    """
    spark = df.sparkSession
    shared_dir(spark)
    rows = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is as large as the corpus and must not be broadcast, whatever its estimate."""
    return df.hint("merge")
