"""Joining ground-truth labels to the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_labels(df: DataFrame, labels: DataFrame, id_col: str = "id", flag: str = "is_malicious") -> DataFrame:
    """1 where the id is labelled, else 0. Row count is unchanged by repeated labels."""
    hits = labels.select(F.col(id_col)).distinct().withColumn("_hit", F.lit(1))
    return df.join(hits, id_col, "left").withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_hit")


def label_flag(raw):
    """A lenient 0/1 label: text that is no number, or a null, counts as 0."""
    return F.coalesce(raw.try_cast("double").cast("int"), F.lit(0))


def attach_scenario(df: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """The scenario of each row, 0 where it has none.

    One scenario per id: an id in several incidents takes the lowest, so a queue
    never grows by the join.
    """
    lookup = labels.groupBy(id_col).agg(F.min("scenario").cast("int").alias("scenario"))
    joined = df.drop("scenario").join(lookup, id_col, "left")
    return joined.withColumn("scenario", F.coalesce("scenario", F.lit(0)))


def scenario_hits(queue: DataFrame, *by: str) -> DataFrame:
    """True positives per scenario."""
    return queue.filter(F.col("is_malicious") == 1).groupBy(*by, "scenario").agg(
        F.count(F.lit(1)).alias("true_positives")
    )


def found_labels(df: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Labelled ids that the log holds. The log is reduced to labelled ids where it is read."""
    return ids_in_both(labels, df, id_col)


def missing_labels(df: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """All labelled ids that the log does not hold."""
    return ids_only_in(labels, df, id_col)


def label_match(df: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows scanned, labels expected, found and missing, from one pass over the log.

    The log side is reduced to the labelled ids before it meets anything else: the
    distinct labels are the build side, and each log row contributes a flag.
    """
    wanted = labels.select(id_col).distinct().withColumn("_wanted", F.lit(1))
    marked = df.select(id_col).join(wanted, id_col, "left")
    seen = marked.agg(
        F.count(F.lit(1)).alias("total_rows_scanned"),
        F.countDistinct(F.when(F.col("_wanted") == 1, F.col(id_col))).alias("n_found"),
    )
    expected = wanted.agg(F.count(F.lit(1)).alias("n_expected"))
    return seen.crossJoin(F.broadcast(expected)).select(
        "total_rows_scanned", "n_expected", "n_found",
        (F.col("n_expected") - F.col("n_found")).alias("n_missing"),
    )


def ids_in_both(small: DataFrame, large: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids of ``small`` that ``large`` holds too.

    ``large`` meets the ids of ``small`` by a semi join, so it is not exchanged while those
    fit a broadcast, and only what is left of it becomes distinct.
    """
    wanted = small.select(id_col).distinct()
    return large.select(id_col).join(wanted, id_col, "left_semi").distinct()


def common_ids(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct ids of both; ``a`` is the smaller table."""
    return ids_in_both(a, b, id_col)


def ids_only_in(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct ids of ``a``, the smaller table, that ``b`` does not hold."""
    return a.select(id_col).distinct().join(ids_in_both(a, b, id_col), id_col, "left_anti")
