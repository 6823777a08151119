import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators.bootstrap import paired_bootstrap, paired_day_difference
from riskloom.operators.capacity import (
    cumulative_regret, daily_metrics, global_budget_metrics, run_summary, top_by_budget,
)
from riskloom.operators.compare import scenario_coverage
from riskloom.operators.labels import attach_scenario, flag_labels, label_match, missing_labels
from riskloom.operators.queues import FILL, check_shares, merge_queues, merged_summary

DAY = dt.date(2024, 1, 1)


def scores(spark, n=40):
    rows = [(i, i, DAY, float(n - i), int(i % 9 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, seq int, day date, risk_score double, is_malicious int")


def adaptive(spark, ids):
    rows = [(i, i, DAY, float(i % 7), int(i % 9 == 0)) for i in ids]
    return spark.createDataFrame(rows, "id int, seq int, day date, ucb_score double, is_malicious int")


@pytest.mark.parametrize("rows_per_task", [5, 10**6])
def test_overlap_is_filled(spark, rows_per_task):
    chosen = adaptive(spark, [0, 1, 30, 31])
    queue = merge_queues(scores(spark), chosen, 0.2, 0.1, rows_per_task=rows_per_task)
    rows = {r["id"]: r["selection_source"] for r in queue.collect()}
    assert len(rows) == 8
    assert sorted(i for i, s in rows.items() if s == FILL) == [4, 5]
    summary = merged_summary(queue, chosen, scores(spark)).first()
    assert (summary["overlap_removed"], summary["static_fill_selection"], summary["n_reviewed"]) == (2, 2, 8)


def test_truncation_order(spark):
    ids = [20, 21, 22, 26, 27, 30]
    by_log = merge_queues(scores(spark), adaptive(spark, ids), 0.2, 0.1)
    assert {r["id"] for r in by_log.collect()} - set(range(4)) == {20, 21, 22, 26}
    by_score = merge_queues(scores(spark), adaptive(spark, ids), 0.2, 0.1, adaptive_order="score")
    best = sorted(ids, key=lambda i: (-(i % 7), i))[:4]
    assert {r["id"] for r in by_score.collect()} - set(range(4)) == set(best)


def test_shares_are_checked():
    for bad in ((0.01, 0.01), (0.0, 0.1), (0.2, 0.1), (0.1, 1.5)):
        with pytest.raises(ValueError):
            check_shares(*bad)
    with pytest.raises(ValueError):
        check_shares(0.05, 0.1, 0.06)
    check_shares(0.05, 0.1, 0.05)


def test_metrics_without_positives_and_above_quota(spark):
    rows = [(i, DAY, float(i), 0) for i in range(10)] + [(20 + i, dt.date(2024, 1, 2), float(i), 1) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, day date, risk_score double, is_malicious int")
    daily = daily_metrics(top_by_budget(df, "risk_score", [0.3], by="day"), df).orderBy("day").collect()
    assert [(r["reviewed"], r["true_positives"], r["oracle_true_positives"], r["reward"], r["oracle_reward"]) for r in daily] == [
        (3, 0, 0, -3.0, -3.0), (3, 3, 3, 30.0, 30.0)
    ]
    quiet = df.filter("is_malicious = 0")
    chosen = top_by_budget(quiet, "risk_score", [0.3], by="day")
    summary = run_summary(daily_metrics(chosen, quiet)).first()
    assert summary["recall"] is None and summary["precision"] == 0.0
    overall = global_budget_metrics(top_by_budget(quiet, "risk_score", [0.3]), quiet).first()
    assert (overall["recall"], overall["n_reviewed"], overall["false_positive_rate"]) == (None, 3, 0.3)
    running = cumulative_regret(daily_metrics(chosen, quiet)).first()
    assert (running["cumulative_reward"], running["cumulative_regret"]) == (-3.0, 0.0)


def test_quota_identity(spark):
    rows = [(i, dt.date(2024, 1, 1 + i % 5), float(i * 37 % 101), 0) for i in range(503)]
    df = spark.createDataFrame(rows, "id int, day date, risk_score double, is_malicious int")
    chosen = top_by_budget(df, "risk_score", [0.01, 0.07], by="day").groupBy("budget", "day").count().collect()
    sizes = {r["day"]: r["count"] for r in df.groupBy("day").count().collect()}
    import math

    for r in chosen:
        assert r["count"] == max(1, math.ceil(sizes[r["day"]] * r["budget"]))


def test_labels(spark):
    log = spark.createDataFrame([(i,) for i in range(10)], "id int")
    labels = spark.createDataFrame([(1, 2), (1, 3), (4, 3), (77, 4)], "id int, scenario int")
    flagged = flag_labels(log, labels)
    assert flagged.count() == 10 and flagged.agg(F.sum("is_malicious")).first()[0] == 2
    assert {r["id"]: r["scenario"] for r in attach_scenario(log, labels).collect()} == {
        **{i: 0 for i in range(10)}, 1: 2, 4: 3
    }
    assert tuple(label_match(log, labels).first()) == (10, 3, 2, 1)
    assert [r[0] for r in missing_labels(log, labels).collect()] == [77]


def test_coverage_shows_zero_hits(spark):
    runs = spark.createDataFrame([("m", 0.1)], "method string, budget double")
    hits = spark.createDataFrame([("m", 0.1, 2, 1)], "method string, budget double, scenario int, true_positives bigint")
    labels = spark.createDataFrame([(1, 2), (2, 2), (3, 4)], "id int, scenario int")
    rows = scenario_coverage(runs, hits, labels).orderBy("scenario").collect()
    assert [(r["scenario"], r["true_positives"], r["scenario_recall"]) for r in rows] == [(2, 1, 0.5), (4, 0, 0.0)]


def series(spark, values, first=0):
    rows = [(DAY + dt.timedelta(days=first + i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "day date, true_positives bigint")


def test_bootstrap(spark):
    a, b = series(spark, [1, 0, 2, 1]), series(spark, [2, 0, 3, 1])
    row = paired_bootstrap(a, b, replicates=400)
    again = paired_bootstrap(a.repartition(3), b, replicates=400)
    assert row.first() == again.first()
    row = row.first()
    assert (row["n_days"], row["total_a"], row["total_b"], row["difference"]) == (4, 4, 6, 2)
    assert 0 <= row["ci_lower"] <= 2 <= row["ci_upper"] <= 4
    with pytest.raises(ValueError, match="differ in their days"):
        paired_day_difference(a, series(spark, [1, 2, 3, 4], first=1))


def test_all_missing_labels_come_back_and_the_log_is_not_exchanged(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/labels")
    spark.range(30, 100_000).write.parquet(f"{tmp_path}/log")
    labels, log = spark.read.parquet(f"{tmp_path}/labels"), spark.read.parquet(f"{tmp_path}/log")
    missing = missing_labels(log, labels)
    assert sorted(r[0] for r in missing.collect()) == list(range(30))
    plan = missing._jdf.queryExecution().toString()
    assert "LeftSemi, BuildRight" in plan and "SortMergeJoin" not in plan
