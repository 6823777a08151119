"""Publishing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import clustered
from riskloom.sources.paths import exists, move, names, read_small, remove, write_once

#: What a whole pointer ends with.
END = "\n"


def publish(
    df: DataFrame, path: str, fmt: str = "parquet",
    overwrite: bool = False, partition_by: list[str] | None = None,
) -> None:
    """Write a table so that readers see the old one until the new one is complete.

    An existing table is refused unless ``overwrite`` is set. The new table is
    written beside the old one and takes its place only after the whole job has
    succeeded; a failed job leaves the old table as it was. Between the two renames at
    the end there is a moment without a table; if the second one fails, the old table
    is put back.
    """
    spark = df.sparkSession
    present = exists(spark, path)
    if present and not overwrite:
        raise FileExistsError(f"{path} exists; pass overwrite=True to replace it")
    staging = f"{path}.in_progress"
    writer = clustered(df, partition_by).write.format(fmt).mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(staging)
    if present:
        retired = f"{path}.retired"
        remove(spark, retired)
        move(spark, path, retired)
        try:
            move(spark, staging, path)
        except Exception:
            move(spark, retired, path)
            raise
        remove(spark, retired)
    else:
        move(spark, staging, path)


def pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions of a table, the newest first."""
    return sorted((n for n in names(spark, f"{path}/pointers") if n.isdigit()), reverse=True)


def publish_version(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Write a table as a new version and point to it; the version's number.

    Data goes to a folder of its own. Then one small pointer file is created, which no two writers can both do. There is no
    moment without a table, and a writer that dies leaves the old version as it was. Of the
    versions the newest ``keep`` stay, so that whoever reads the one before can end.
    """
    spark = df.sparkSession
    before = pointers(spark, path)
    number = f"{int(before[0]) + 1 if before else 1:09d}"
    folder = f"versions/{number}-{uuid.uuid4().hex}"
    writer = clustered(df, partition_by).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{folder}")
    write_once(spark, f"{path}/pointers/{number}", folder + END)
    for old in before[max(keep, 1) - 1:]:
        retired = read_small(spark, f"{path}/pointers/{old}").removesuffix(END)
        remove(spark, f"{path}/pointers/{old}")
        if retired:
            remove(spark, f"{path}/{retired}")
    return number


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A published table, the newest version unless one is named. A pointer that was not written to its end counts as none."""
    for number in [version] if version else pointers(spark, path):
        text = read_small(spark, f"{path}/pointers/{number}")
        if text.endswith(END):
            return spark.read.parquet(f"{path}/{text.removesuffix(END)}")
    raise FileNotFoundError(f"nothing is published at {path}")


def publish_summary(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a run summary of one row as one JSON document."""
    publish(df.repartition(1), path, "json", overwrite)


def as_summary(df: DataFrame, key: str, name: str) -> DataFrame:
    """Fold a small keyed table into one row with a map column."""
    values = [c for c in df.columns if c != key]
    entry = F.struct(F.col(key).cast("string"), F.struct(*values) if len(values) > 1 else F.col(values[0]))
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))
