"""Per-event metadata features and the assembled feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import scalars as S

METADATA = [
    "size", "attachment_count", "n_recipients_internal", "n_recipients_external",
    "has_external_recipient", "hour_of_day", "is_after_hours", "is_weekend",
]


def parse_log(df: DataFrame) -> DataFrame:
    """Type an all-text log: adds ``ts``, ``day`` and a numeric ``size``."""
    return df.withColumns({
        "ts": S.event_time(F.col("date")),
        "day": F.to_date(S.event_time(F.col("date"))),
        "size": S.number(F.col("size")),
    })


def activity_features(
    df: DataFrame,
    domain: str = C.INTERNAL_DOMAIN,
    start_hour: int = C.WORKDAY_START_HOUR,
    end_hour: int = C.WORKDAY_END_HOUR,
    anchored: bool = False,
    keep: tuple[str, ...] = ("id", "ts", "user"),
) -> DataFrame:
    """Size, attachments, recipients and timing of each event; ``keep`` passes through."""
    internal = sum((S.internal_items(F.col(c), domain, anchored) for c in C.RECIPIENT_COLUMNS), F.lit(0))
    total = sum((S.list_items(F.col(c)) for c in C.RECIPIENT_COLUMNS), F.lit(0))
    ts = F.col("ts")
    return df.select(
        *keep,
        S.number(F.col("size")).alias("size"),
        S.list_items(F.col("attachments")).cast("double").alias("attachment_count"),
        internal.cast("double").alias("n_recipients_internal"),
        (total - internal).cast("double").alias("n_recipients_external"),
        (total > internal).cast("int").alias("has_external_recipient"),
        F.hour(ts).alias("hour_of_day"),
        S.after_hours(ts, start_hour, end_hour).alias("is_after_hours"),
        S.weekend(ts).alias("is_weekend"),
    )


def expand_components(df: DataFrame, column: str = "embed_pc", k: int = C.PCA_COMPONENTS) -> DataFrame:
    """Replace a component array by one column per component."""
    parts = [F.col(column)[i].alias(f"{column}_{i}") for i in range(k)]
    return df.select(*[c for c in df.columns if c != column], *parts)


def feature_run_counts(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("user").alias("n_users_seen"),
        F.coalesce(F.sum("is_malicious"), F.lit(0)).cast("bigint").alias("n_malicious_rows"),
    )


def split_by_time(df: DataFrame, train_end: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to the end of the inclusive day, and rows after it. Rows without a
    time are in neither."""
    cut = F.date_add(F.lit(train_end).cast("date"), 1).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) < cut), df.filter(F.col(ts) >= cut)


def split_counts(df: DataFrame, train_end: str, ts: str = "ts") -> DataFrame:
    cut = F.date_add(F.lit(train_end).cast("date"), 1).cast(df.schema[ts].dataType)
    test = F.col(ts) >= cut
    return df.agg(
        F.count_if(F.col(ts) < cut).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.count_if(test & (F.col("is_malicious") == 1)).alias("n_test_malicious"),
    )
