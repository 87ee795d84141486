"""Session set-up for local runs, and the shared folder that cut lineage is written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "threadtide", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; made up only for a local master that names none."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="threadtide-")
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: survives executor loss, pins what is not
    deterministic above it, and readers still prune columns and see true sizes."""
    path = fresh_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most_bytes: int = 2 << 20) -> None:
    """From now on tasks hand rows to Python in Arrow batches of about ``most_bytes`` at most, a longer row alone; by default
    10,000 rows or 64 MB, which a task holds several times, on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a small input sits in fewer partitions; larger inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
