"""Merging a static and an adaptive review queue under one daily capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.functions.ordering import ROWS_PER_TASK, Key, take_in_order
from riskloom.operators.capacity import SCORE_PLACES, top_by_budget
from riskloom.session import materialize

STATIC, ADAPTIVE, FILL = "Static baseline", "LinUCB", "Static baseline fill"


def check_shares(static_budget: float, target_budget: float, adaptive_budget: float | None = None) -> None:
    if not 0 < static_budget < target_budget <= 1:
        raise ValueError("the shares must satisfy 0 < static < target <= 1")
    if adaptive_budget is not None and adaptive_budget > target_budget - static_budget + 1e-12:
        raise ValueError("the adaptive queue was made for more than the share left to it")


def merge_queues(
    scores: DataFrame,
    adaptive: DataFrame,
    target_budget: float = 0.01,
    static_budget: float = 0.005,
    adaptive_budget: float | None = None,
    adaptive_order: str = "seq",
    day: str = "day",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """A daily queue of fixed size out of two rankings.

    Each day takes the best static rows first, then the adaptive rows that are not
    among them, up to the target; an overlap leaves room that the next-best static
    rows of the day fill. Adaptive rows keep log order at the edge (``seq``), or the
    order of their own score (``score``). ``scores`` needs ``id, day, seq, risk_score``
    and the columns wanted in the queue; ``adaptive`` needs ``id, day, seq, ucb_score``.

    Joins are on ``(day, id)``, so a busy day spreads over many tasks.
    """
    check_shares(static_budget, target_budget, adaptive_budget)
    if adaptive_order not in ("seq", "score"):
        raise ValueError("adaptive_order must be 'seq' or 'score'")
    # One selection serves the static share and, later, the fill.
    best = materialize(
        top_by_budget(
            scores, "risk_score", [static_budget, target_budget], by=day, tie="seq",
            rank="_place", rows_per_task=rows_per_task,
        ),
        "static-ranked",
    )
    static = best.filter(F.col("budget") == static_budget).drop("budget", "_place")
    static = static.withColumns({"selection_source": F.lit(STATIC), "ucb_score": F.lit(None).cast("double")})
    targets = scores.groupBy(day).agg(F.count(F.lit(1)).alias("_n")).select(
        day, S.quota(F.col("_n"), F.lit(target_budget)).alias("_target")
    )
    taken = static.groupBy(day).agg(F.count(F.lit(1)).alias("_static"))
    room = materialize(
        targets.join(taken, day, "left").select(
            day, "_target", (F.col("_target") - F.coalesce("_static", F.lit(0))).alias("quota")
        ),
        "queue-room",
    )
    extra = adaptive.join(static.select(day, "id"), [day, "id"], "left_anti")
    order = [Key("seq")]
    if adaptive_order == "score":
        extra = extra.withColumn("_score", F.round("ucb_score", SCORE_PLACES))
        order = [Key("_score", descending=True), Key("seq")]
    admitted = take_in_order(extra, [day], order, room.select(day, "quota"), rows_per_task)
    admitted = admitted.drop("_score").withColumn("selection_source", F.lit(ADAPTIVE))
    queue = materialize(static.unionByName(admitted, allowMissingColumns=True), "merged-queue")

    used = queue.groupBy(day).agg(F.count(F.lit(1)).alias("_used"))
    spare = materialize(
        room.join(used, day, "left")
        .select(day, (F.col("_target") - F.coalesce("_used", F.lit(0))).alias("quota"))
        .filter(F.col("quota") > 0),
        "queue-spare",
    )
    # Enough candidates: of the best ``target`` static rows of a day, at most the queue is taken.
    pool = best.filter(F.col("budget") == target_budget).drop("budget")
    rest = pool.join(queue.select(day, "id"), [day, "id"], "left_anti")
    fill = take_in_order(rest, [day], [Key("_place")], spare, rows_per_task).drop("_place")
    fill = fill.withColumn("selection_source", F.lit(FILL))
    return queue.unionByName(fill, allowMissingColumns=True)


def overlap(static: DataFrame, adaptive: DataFrame, day: str = "day") -> DataFrame:
    """Rows that both queues chose on the same day."""
    return adaptive.select(day, "id").join(static.select(day, "id"), [day, "id"], "left_semi")


def merged_summary(queue: DataFrame, adaptive: DataFrame, population: DataFrame, day: str = "day") -> DataFrame:
    """One row: the size of the queue, where its rows came from, and its metrics."""
    source = F.col("selection_source")
    parts = queue.agg(
        F.count(F.lit(1)).alias("n_reviewed"),
        F.coalesce(F.sum("is_malicious"), F.lit(0)).cast("bigint").alias("true_positives"),
        F.count_if(source == STATIC).alias("static_initial_selection"),
        F.count_if(source == FILL).alias("static_fill_selection"),
    )
    initial = adaptive.agg(F.count(F.lit(1)).alias("linucb_initial_selection"))
    removed = overlap(queue.filter(source == STATIC), adaptive, day).agg(
        F.count(F.lit(1)).alias("overlap_removed")
    )
    totals = population.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.coalesce(F.sum("is_malicious"), F.lit(0)).cast("bigint").alias("available_malicious"),
    )
    # Four tables of one row each.
    row = parts
    for other in (initial, removed, totals):
        row = row.crossJoin(F.broadcast(other))
    tp, k, pos = F.col("true_positives"), F.col("n_reviewed"), F.col("available_malicious")
    return row.select(
        "n_test", "n_reviewed", "true_positives", "available_malicious",
        S.ratio(tp, k).alias("precision"), S.ratio(tp, pos).alias("recall"),
        S.ratio(k - tp, F.greatest(F.col("n_test") - pos, F.lit(1))).alias("false_positive_rate"),
        "static_initial_selection", "linucb_initial_selection", "overlap_removed", "static_fill_selection",
    )
