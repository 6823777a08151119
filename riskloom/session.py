"""Session helpers: where intermediate tables go, and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks, with the web page off."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a fresh
    temporary folder, remembered in the session for later calls.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("riskloom.local.workdir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set("riskloom.local.workdir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clustered(df: DataFrame, partition_by: list[str] | None) -> DataFrame:
    """Rows arranged for a partitioned write.

    Without this every task would write a file into every partition. Rebalancing
    brings a partition's rows together, and adaptive execution splits a partition that
    is far larger than the rest, so a busy day becomes many files, not one task.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


def materialize(
    df: DataFrame, label: str, partition_by: list[str] | None = None, arranged: bool = False, row_group: int | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Rows that are ``arranged`` by the partition columns already are written as they lie. ``row_group`` is the size
    of a row group in bytes, the least that a reading task takes, where the format's 128 MB are too many.

    The result has no lineage to recompute when an executor is lost, its columns
    prune, and its file size is known, so Catalyst chooses broadcast joins from a
    measured size instead of a guess.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = (df if arranged else clustered(df, partition_by)).write
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
