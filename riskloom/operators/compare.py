"""Side-by-side tables of review policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalars as S

COMPARED = [
    "method", "budget", "n_reviewed", "true_positives", "precision", "recall",
    "false_positive_rate", "cumulative_regret",
]


def policy_rows(summary: DataFrame, method: str, with_regret: bool = False) -> DataFrame:
    """The rows of one method. Regret is meant for policies that learn; others show null."""
    regret = F.col("cumulative_regret") if with_regret else F.lit(None)
    return summary.withColumns({
        "method": F.lit(method), "cumulative_regret": regret.cast("double"),
    }).select(*COMPARED)


def static_rows(global_summary: DataFrame, daily_summary: DataFrame | None = None) -> DataFrame:
    """The static method under the daily convention if that was run, else the global one."""
    return policy_rows(daily_summary if daily_summary is not None else global_summary, "Static anomaly baseline")


def compare_policies(tables: list[DataFrame]) -> DataFrame:
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result.orderBy("budget", "method")


def scenario_coverage(runs: DataFrame, hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Recall per scenario for every run; a scenario without hits shows 0.

    ``runs`` lists the ``method, budget`` pairs and ``hits`` their true positives. The
    grid is runs times scenarios, both of them report dimensions.
    """
    totals = labels.groupBy("scenario").agg(F.count(F.lit(1)).alias("malicious_emails_in_scenario"))
    grid = runs.select("method", "budget").distinct().crossJoin(F.broadcast(totals))
    joined = grid.join(hits, ["method", "budget", "scenario"], "left")
    return joined.select(
        "method", "budget", "scenario", "malicious_emails_in_scenario",
        F.coalesce("true_positives", F.lit(0)).alias("true_positives"),
    ).withColumn(
        "scenario_recall", S.ratio(F.col("true_positives"), F.col("malicious_emails_in_scenario"))
    )
