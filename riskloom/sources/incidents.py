"""Ground truth: the incident index and its ragged detail files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions.scalars import event_time
from riskloom.sources.logs import QUOTED_CSV, csv_name, text_schema

INDEX_COLUMNS = ["dataset", "scenario", "details", "user", "start", "end"]
PREFIX_COLUMNS = ["log_type", "id", "date", "user"]


def read_incident_index(spark: SparkSession, path: str, release: str = C.RELEASE) -> DataFrame:
    """Incidents of one release. A malformed window time becomes null, not an error."""
    index = (
        spark.read.schema(text_schema(INDEX_COLUMNS)).options(**QUOTED_CSV).csv(path).na.fill("")
        .filter(F.col("dataset") == release)
        .withColumn("start_ts", event_time(F.col("start"), C.INDEX_TIME_FORMAT))
        .withColumn("end_ts", event_time(F.col("end"), C.INDEX_TIME_FORMAT))
    )
    if index.isEmpty():
        raise ValueError(f"no incident of release {release!r} in {path}")
    return index


def read_detail_rows(spark: SparkSession, path: str) -> DataFrame:
    """The first four fields of headerless rows of any width, and the file they came from.

    Long rows keep the prefix; fields a short row lacks are empty text. All files of
    the folder are one scan.
    """
    return (
        spark.read.schema(text_schema(PREFIX_COLUMNS))
        .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("multiLine", True)
        .csv(path)
        .withColumn("details", csv_name())
        .na.fill("")
        .filter(F.concat(*PREFIX_COLUMNS) != "")
    )


def detail_counts(details: DataFrame, log_type: str = "email") -> DataFrame:
    return details.groupBy("details").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("log_type") == log_type).alias("n_matching"),
    )


def missing_details(index: DataFrame, details: DataFrame) -> DataFrame:
    """Incidents whose detail file is absent."""
    return index.join(details.select("details").distinct(), "details", "left_anti")


def extract_labels(index: DataFrame, details: DataFrame, log_type: str = "email") -> DataFrame:
    """Rows of one log type from every incident's detail file, tagged with its owner."""
    incidents = index.select("details", "scenario", F.col("user").alias("insider_user"))
    return details.filter(F.col("log_type") == log_type).join(incidents, "details").select(
        "id", F.col("scenario").try_cast("int").alias("scenario"), "insider_user",
        F.col("user").alias("email_row_user"), "date",
    )


def read_incidents(
    spark: SparkSession, index_path: str, detail_path: str,
    release: str = C.RELEASE, log_type: str = "email",
) -> DataFrame:
    """Labels of a release. Incidents without a detail file are named in a warning."""
    index = read_incident_index(spark, index_path, release)
    details = read_detail_rows(spark, detail_path)
    missing = missing_details(index, details).select("details").distinct()
    if absent := missing.count():
        some = sorted(r[0] for r in missing.limit(5).collect())
        warnings.warn(f"{absent} detail files missing, skipped, such as {some}", stacklevel=2)
    return extract_labels(index, details, log_type)


def label_coverage(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.countDistinct("scenario").alias("n_scenarios"),
    )
