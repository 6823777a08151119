"""Static, label-free anomaly scores against each user's own history."""

from __future__ import annotations

from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import scalars as S
from riskloom.session import materialize


@dataclass(frozen=True)
class UserStats:
    """Frozen statistics: a table with one row per user, and the values over all users."""

    users: DataFrame
    overall: dict[str, float]
    numeric: tuple[str, ...]
    flags: tuple[str, ...]


def user_moments(df: DataFrame, columns: list[str], user: str = "user") -> DataFrame:
    """Count, mean and population variance of every feature per user.

    Partial sums combine before the shuffle, so a busy user costs no more than a
    quiet one. The variance merges centred moments and does not cancel.
    """
    values = df.select(user, *[S.scaled_feature(c).alias(c) for c in columns])
    parts = []
    for c in columns:
        parts += [
            F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), F.var_pop(c).alias(f"{c}__var"),
        ]
    return values.groupBy(user).agg(*parts)


def pooled_moments(users: DataFrame, columns: list[str]) -> DataFrame:
    """Moments over all rows from the per-user table, without another scan.

    The overall variance is the mean variance within users plus the variance
    between their means.
    """
    means = users.agg(*[
        F.expr(f"try_divide(sum({c}__n * {c}__mean), cast(sum({c}__n) as double)) as {c}__gmean")
        for c in columns
    ])
    parts = []
    for c in columns:
        within = f"{c}__n * ({c}__var + pow({c}__mean - {c}__gmean, 2))"
        parts += [
            F.expr(f"coalesce(sum({c}__n), 0) as {c}__gn"),
            F.expr(f"max({c}__gmean) as {c}__gmean"),
            F.expr(f"try_divide(sum({within}), cast(sum({c}__n) as double)) as {c}__gvar"),
        ]
    return users.crossJoin(F.broadcast(means)).agg(*parts)  # means is one row


def deviation_of(variance: Column, floor: float) -> Column:
    return F.sqrt(F.greatest(variance, F.lit(floor)))


def fit_user_stats(
    train: DataFrame,
    user: str = "user",
    numeric: list[str] | None = None,
    flags: list[str] | None = None,
) -> UserStats:
    """Fit on the training rows only; no label is read.

    The per-user table is written once, which freezes it, and the one row over all
    users is read from it. Fails when there are no training rows, or a feature has no
    value at all.
    """
    numeric = list(numeric or C.NUMERIC_FEATURES)
    flags = list(flags or C.RARITY_FEATURES)
    columns = numeric + flags
    users = materialize(user_moments(train, columns, user), "user-moments")
    overall = pooled_moments(users, columns).first().asDict()
    if not any(overall[f"{c}__gn"] for c in columns):
        raise ValueError("no training rows up to the cut-off")
    empty = [c for c in columns if not overall[f"{c}__gn"]]
    if empty:
        raise ValueError(f"features without any training value: {empty}")
    return UserStats(users, overall, tuple(numeric), tuple(flags))


def effective_stats(stats: UserStats, user: str, min_history: int) -> DataFrame:
    """What each user is measured against: own statistics, or everyone's where history
    is thin. One row per user, so the choice is made once and not per event."""
    enough = _all_at_least([f"{c}__n" for c in stats.numeric], min_history)
    enough_flags = _all_at_least([f"{c}__n" for c in stats.flags], min_history)
    centre = [
        F.when(enough, F.col(f"{c}__mean")).otherwise(F.lit(stats.overall[f"{c}__gmean"])).alias(f"_m_{c}")
        for c in stats.numeric
    ]
    spread = [
        _deviation(F.when(enough, F.col(f"{c}__var")).otherwise(F.lit(stats.overall[f"{c}__gvar"]))).alias(f"_s_{c}")
        for c in stats.numeric
    ]
    weight = [
        rarity_weight_of(
            F.when(enough_flags, F.col(f"{c}__mean")).otherwise(F.lit(stats.overall[f"{c}__gmean"]))
        ).alias(f"_w_{c}")
        for c in stats.flags
    ]
    return stats.users.select(user, (~enough).cast("int").alias("_thin"), *centre, *spread, *weight)


def floored(variance: float) -> float:
    return sqrt(max(variance, C.VARIANCE_FLOOR))


def rarity_weight_of(rate: Column) -> Column:
    return -F.log(F.greatest(rate, F.lit(C.RATE_FLOOR)))


def _deviation(variance: Column) -> Column:
    return deviation_of(variance, C.VARIANCE_FLOOR)


def score_anomaly(
    df: DataFrame,
    stats: UserStats,
    user: str = "user",
    min_history: int = C.MIN_HISTORY,
    max_z: float = C.MAX_Z,
    rarity_weight: float = C.RARITY_WEIGHT,
    keep: tuple[str, ...] = ("id", "ts", "user", "is_malicious"),
) -> DataFrame:
    """Score rows against frozen statistics.

    A user with fewer than ``min_history`` values in any numeric feature is measured
    against everyone; rarity has its own counts and its own fallback. The user table
    is joined by whatever strategy its measured size allows, and adaptive execution
    splits a skewed user.
    """
    columns = [*stats.numeric, *stats.flags]
    every = stats.overall
    values = df.withColumns({f"_v_{c}": S.scaled_feature(c) for c in columns})
    joined = values.join(effective_stats(stats, user, min_history), user, "left")
    clipped = [
        # ``least`` skips nulls, so a missing value must not reach it.
        f"if(_v_{c} is null, 0D, least(abs((_v_{c} - coalesce(_m_{c}, {every[f'{c}__gmean']!r}D))"
        f" / coalesce(_s_{c}, {floored(every[f'{c}__gvar'])!r}D)), {float(max_z)!r}D))"
        for c in stats.numeric
    ]
    present = " + ".join(f"int(_v_{c} is not null)" for c in stats.numeric)
    numeric = F.expr(f"if({present} > 0, ({' + '.join(clipped)}) / ({present}), 0D)")
    rarity = F.expr(" + ".join(
        f"coalesce(_v_{c}, 0D) * coalesce(_w_{c}, {-log(max(every[f'{c}__gmean'], C.RATE_FLOOR))!r}D)"
        for c in stats.flags
    ))
    return (
        joined.withColumns({
            "numeric_anomaly": numeric,
            "rarity_anomaly": rarity,
            "uses_global_fallback": F.coalesce("_thin", F.lit(1)),
        })
        .withColumn("risk_score", F.col("numeric_anomaly") + F.lit(rarity_weight) * F.col("rarity_anomaly"))
        .select(*keep, "numeric_anomaly", "rarity_anomaly", "risk_score", "uses_global_fallback")
    )


def _all_at_least(counts: list[str], least: int) -> Column:
    return F.least(*counts) >= least if len(counts) > 1 else F.col(counts[0]) >= least
