"""Choosing rows under a review budget, and measuring the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import scalars as S
from riskloom.functions.ordering import ROWS_PER_TASK, Key, take_in_order
from riskloom.session import materialize

SCORE_PLACES = 9


def check_budgets(budgets) -> list[float]:
    budgets = [float(b) for b in budgets]
    if not budgets or any(not 0 < b <= 1 for b in budgets):
        raise ValueError("a review budget must lie in (0, 1]")
    return budgets


def group_quotas(df: DataFrame, budgets: list[float], by: list[str]) -> DataFrame:
    """Rows and review slots per group and budget."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    budget = F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")
    quotas = counts.select(*by, "n_rows", budget)
    return quotas.withColumn("quota", S.quota(F.col("n_rows"), F.col("budget")))


def top_by_budget(
    df: DataFrame,
    score: str,
    budgets,
    by: str | list[str] | None = None,
    tie: str = "id",
    rank: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The ``max(1, ceil(n * budget))`` best rows of each group, one copy per budget.

    ``by`` names the group (a day, usually); without it the whole table is one group.
    Scores compare after rounding to nine places and equal scores go by ``tie``, never
    by label. Only the greatest quota is selected from the table; smaller budgets take
    their share from the ranked selection.
    """
    budgets = check_budgets(budgets)
    by = [by] if isinstance(by, str) else list(by or [])
    group = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    quotas = materialize(group_quotas(rows, budgets, group), "quotas")
    largest = quotas.agg(F.max("n_rows")).first()[0]
    rows = rows.withColumn("_score", F.round(F.col(score).cast("double"), SCORE_PLACES))
    keys = [Key("_score", descending=True), Key(tie)]
    if len(budgets) == 1 and rank is None:
        chosen = take_in_order(rows, group, keys, quotas.select(*group, "quota"), rows_per_task, largest=largest)
        chosen = chosen.withColumn("budget", F.lit(budgets[0]))
    else:
        most = quotas.groupBy(*group).agg(F.max("quota").alias("quota"))
        position = rank or "_position"
        ranked = take_in_order(rows, group, keys, most, rows_per_task, position, largest)
        chosen = (
            ranked.join(quotas.select(*group, "budget", "quota"), group)
            .filter(F.col(position) <= F.col("quota")).drop("quota")
        )
        chosen = chosen if rank else chosen.drop(position)
    return chosen.drop("_score", "_all") if not by else chosen.drop("_score")


def above_threshold(df: DataFrame, score: str, budgets, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows at or above the k-th greatest score of each budget; ties may exceed k."""
    rows = df.withColumn("_score", F.round(F.col(score).cast("double"), SCORE_PLACES))
    best = top_by_budget(df.select(score, "id"), score, budgets, rows_per_task=rows_per_task)
    edges = best.groupBy("budget").agg(
        F.min(F.round(F.col(score).cast("double"), SCORE_PLACES)).alias("threshold")
    )
    # One row per budget.
    joined = rows.join(F.broadcast(edges), F.col("_score") >= F.col("threshold"))
    return joined.drop("_score")


def global_budget_metrics(selected: DataFrame, population: DataFrame) -> DataFrame:
    """Metrics of a global selection, one row per budget."""
    totals = population.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.coalesce(F.sum("is_malicious"), F.lit(0)).cast("bigint").alias("n_pos"),
    )
    reviewed = selected.groupBy("budget").agg(
        F.count(F.lit(1)).alias("n_reviewed"),
        F.sum("is_malicious").cast("bigint").alias("true_positives"),
    )
    tp, k = F.col("true_positives"), F.col("n_reviewed")
    return reviewed.crossJoin(F.broadcast(totals)).select(
        "budget", "n_reviewed", "true_positives",
        S.ratio(tp, k).alias("precision"),
        S.ratio(tp, F.col("n_pos")).alias("recall"),
        S.ratio(k - tp, F.greatest(F.col("n_test") - F.col("n_pos"), F.lit(1))).alias("false_positive_rate"),
    )


def daily_metrics(
    selected: DataFrame,
    population: DataFrame,
    day: str = "day",
    by: tuple[str, ...] = ("budget",),
    reward: float = C.TRUE_POSITIVE_REWARD,
    cost: float = C.REVIEW_COST,
) -> DataFrame:
    """One row per day (and budget or policy): volume, hits, reward and the best possible.

    Both sides are combined to one row per day before they meet.
    """
    volume = population.groupBy(day).agg(
        F.count(F.lit(1)).alias("emails"),
        F.sum("is_malicious").cast("bigint").alias("available_malicious"),
    )
    reviewed = selected.groupBy(day, *by).agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.sum("is_malicious").cast("bigint").alias("true_positives"),
    )
    joined = reviewed.join(volume, day)
    return add_rewards(joined, F.lit(float(reward)), F.lit(float(cost))).select(
        day, *by, "emails", "reviewed", "true_positives", "false_positives",
        "available_malicious", "oracle_true_positives", "reward", "oracle_reward",
    )


def add_rewards(daily: DataFrame, reward: Column, cost: Column) -> DataFrame:
    def worth(hits: str) -> Column:
        return F.col(hits) * reward - (F.col("reviewed") - F.col(hits)) * cost

    return daily.withColumns({
        "false_positives": F.col("reviewed") - F.col("true_positives"),
        "oracle_true_positives": F.least("reviewed", "available_malicious"),
    }).withColumns({"reward": worth("true_positives"), "oracle_reward": worth("oracle_true_positives")})


def run_summary(daily: DataFrame, by: tuple[str, ...] = ("budget",)) -> DataFrame:
    """Roll a daily series up to one row per run, with regret against the best possible."""
    sums = daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        *[
            F.sum(c).cast("bigint").alias(c)
            for c in ["emails", "reviewed", "true_positives", "false_positives",
                      "available_malicious", "oracle_true_positives"]
        ],
        F.sum("reward").alias("cumulative_reward"),
        F.sum("oracle_reward").alias("oracle_reward"),
    )
    negatives = F.greatest(F.col("emails") - F.col("available_malicious"), F.lit(1))
    return sums.select(
        *by, "n_days", F.col("emails").alias("n_test"), F.col("reviewed").alias("n_reviewed"),
        "true_positives", "available_malicious", "oracle_true_positives",
        S.ratio(F.col("true_positives"), F.col("reviewed")).alias("precision"),
        S.ratio(F.col("true_positives"), F.col("available_malicious")).alias("recall"),
        S.ratio(F.col("false_positives"), negatives).alias("false_positive_rate"),
        "cumulative_reward", "oracle_reward",
        (F.col("oracle_reward") - F.col("cumulative_reward")).alias("cumulative_regret"),
    )


def cumulative_regret(daily: DataFrame, by: tuple[str, ...] = ("budget",), day: str = "day") -> DataFrame:
    """Reward and regret up to each day. The input is one row per day, so the window is small."""
    window = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        day, *by,
        F.sum("reward").over(window).alias("cumulative_reward"),
        F.sum(F.col("oracle_reward") - F.col("reward")).over(window).alias("cumulative_regret"),
    )


def day_sequence(df: DataFrame, day: str = "day") -> DataFrame:
    """The calendar days that occur, numbered in order. The window sees one row per day."""
    days = df.filter(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("emails"))
    return days.withColumn("day_number", F.dense_rank().over(Window.orderBy(day)).cast("bigint"))
