"""Session helpers: building a local session, shared scratch space, run-to-storage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parlatrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = getattr(spark, "_parlatrace_scratch", None)
        if conf is None:
            if not spark.sparkContext.master.startswith("local"):  # local-cluster[..] has executors of its own, but on this machine
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="parlatrace-")
            spark._parlatrace_scratch = conf
    return conf.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder per application, which is removed when the driver ends."""
    root = f"{scratch_dir(spark)}/parlatrace/{spark.sparkContext.applicationId}"
    if getattr(spark, "_parlatrace_clears", None) != root:
        spark._parlatrace_clears = root
        atexit.register(clear_scratch, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession, root: str | None = None) -> None:
    """Remove all that this application cut to storage; DataFrames that still read it are of no more use."""
    root = root or getattr(spark, "_parlatrace_clears", None)
    context = spark.sparkContext
    if root and context._jsc is not None and not context._jsc.sc().isStopped():
        with contextlib.suppress(Exception):  # the driver may be ending because its JVM has
            path = context._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and several readers share one run."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores. For work in Python on tables of few files, which would leave cores idle; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
