"""Paired day bootstrap of two policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import hashed_index

SEED = 20260813
REPLICATES = 10_000


def paired_day_difference(a: DataFrame, b: DataFrame, unit: str = "day", value: str = "true_positives") -> DataFrame:
    """``b`` minus ``a`` per day. Both series must hold the same days."""
    paired = a.select(unit, F.col(value).alias("value_a")).join(
        b.select(unit, F.col(value).alias("value_b")), unit, "full_outer"
    )
    lone = paired.filter(F.col("value_a").isNull() | F.col("value_b").isNull())
    if not lone.isEmpty():
        raise ValueError(f"the two series differ in their days, for example {lone.first()[unit]}")
    return paired.withColumn("difference", F.col("value_b") - F.col("value_a"))


def paired_bootstrap(
    a: DataFrame,
    b: DataFrame,
    unit: str = "day",
    value: str = "true_positives",
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """Difference of two daily series with a 95% percentile interval: one row.

    A replicate draws as many days as there are, with replacement. The draw is a hash
    of seed, replicate and position, so it does not depend on how the work is spread.
    """
    paired = paired_day_difference(a, b, unit, value)
    # One row per calendar day: the numbering window and the broadcast stay small.
    numbered = paired.withColumn("at", F.row_number().over(Window.orderBy(unit)) - 1)
    n = paired.count()
    if n == 0:
        raise ValueError("no day to resample")
    draws = a.sparkSession.range(replicates * n).select(
        F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("position")
    )
    index = hashed_index(F.lit(n), F.lit(seed), F.col("replicate"), F.col("position"))
    sums = (
        draws.withColumn("at", index)
        .join(F.broadcast(numbered.select("at", "difference")), "at")
        .groupBy("replicate").agg(F.sum("difference").alias("total"))
    )
    spread = sums.agg(
        F.percentile("total", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.round(F.avg((F.col("total") > 0).cast("int")), 4).alias("probability_b_greater"),
    )
    point = paired.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("value_a").alias("total_a"), F.sum("value_b").alias("total_b"),
        F.sum("difference").alias("difference"),
    )
    return point.crossJoin(F.broadcast(spread)).select(
        "n_days", "total_a", "total_b", "difference",
        F.round(F.col("q")[0], 2).alias("ci_lower"), F.round(F.col("q")[1], 2).alias("ci_upper"),
        "probability_b_greater",
    )
