"""Monthly directory snapshots."""

from __future__ import annotations

import csv
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.logs import QUOTED_CSV, csv_name, text_schema
from riskloom.sources.paths import exists


def headers(spark: SparkSession, glob: str) -> dict[tuple[str, ...], list[str]]:
    """The files under each header found. One line a file reaches the driver; a header has no line breaks."""
    lines = spark.read.text(glob).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("start"))
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.collect():
        found.setdefault(tuple(next(csv.reader([row["line"]]))), []).append(row["file"])
    return found


def read_snapshots(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """All snapshots as one table, each row tagged with its month.

    A month is one file ``2010-01.csv``, or a folder of that name with part files. Files are united by the names in
    their headers, in whatever order these stand; names beyond ``columns`` are left out, a file that lacks
    one is refused. Files without a line give no rows.
    """
    if not exists(spark, glob):
        raise FileNotFoundError(f"no snapshot file at {glob}")
    month = F.regexp_replace(csv_name(), r"\.csv$", "")
    tables = []
    for header, files in headers(spark, glob).items():
        lacking = [c for c in columns if c not in header]
        if lacking or len(set(header)) < len(header):
            raise ValueError(f"snapshot columns do not match\nexpected: {columns}\nfound:    {list(header)} in {files[0]}")
        rows = spark.read.schema(text_schema(list(header))).options(**QUOTED_CSV).csv(files)
        tables.append(rows.withColumn("snapshot_month", month).select(*columns, "snapshot_month"))
    if not tables:
        return spark.createDataFrame([], text_schema([*columns, "snapshot_month"]))
    return reduce(DataFrame.unionByName, tables).na.fill("")


def read_zipped_snapshots(
    spark: SparkSession, archive: str, columns: list[str], prefix: str = "LDAP/"
) -> DataFrame:
    """The same from the members of a zip archive, one task per month."""
    from riskloom.sources.archive import ZippedCsvSource

    spark.dataSource.register(ZippedCsvSource)
    raw = (
        spark.read.format("zipped_csv").schema(text_schema([*columns, "member"]))
        .option("member", prefix + r".*\.csv").option("archives", json.dumps([archive])).load()
    )
    month = F.regexp_extract("member", r"([^/]*)\.csv$", 1)
    return raw.withColumn("snapshot_month", month).drop("member")


def snapshot_summary(snapshots: DataFrame, user: str = "user_id") -> DataFrame:
    return snapshots.agg(
        F.countDistinct("snapshot_month").alias("n_snapshots"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(user).alias("n_users"),
    )
