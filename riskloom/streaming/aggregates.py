"""Running profile and daily volume of a log stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.operators.profile import log_measures


def profile_stream(stream: DataFrame, domain: str = C.INTERNAL_DOMAIN) -> DataFrame:
    """The running profile per activity; in complete mode every trigger gives the whole.

    State is one row per activity. Distinct users are a sketch, which is the form a
    stream can merge.
    """
    measures = log_measures(stream, domain)
    return measures.groupBy("activity").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("size_bytes").alias("mean"), F.stddev_pop("size_bytes").alias("std"),
        F.min("size_bytes").alias("min"), F.max("size_bytes").alias("max"),
        F.count_if(F.col("attachments_per_row") > 0).alias("n_with_attachment"),
        F.count_if(F.col("recipients_external") > 0).alias("n_with_external"),
        F.approx_count_distinct("user").alias("approx_users"),
    )


def daily_stream(stream: DataFrame, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Rows per calendar day. In append mode a day appears once, when the first row of a
    later day passes it; rows more than ``late`` behind are dropped. In complete mode
    the open last day is shown too."""
    window = F.window(ts, "1 day")
    counts = stream.withWatermark(ts, late).groupBy(window).agg(F.count(F.lit(1)).alias("emails"))
    return counts.select(F.to_date("window.start").alias("day"), "emails")
