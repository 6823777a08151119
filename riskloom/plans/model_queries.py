"""Semantics, the static model and review capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.operators import anomaly, capacity
from riskloom.operators import labels as lab
from riskloom.operators.features import activity_features, split_by_time
from riskloom.operators.reduction import batch_vector_moments, causal_batch_moments, causal_pca
from riskloom.operators.semantic import semantic_deviation, vector_dims
from riskloom.plans import fixtures as fx
from riskloom.plans import sql
from riskloom.session import materialize

COMPONENTS = 8


def deviation(spark, sf):
    log = fx.activity(spark, sf, embedding=True, pack=True).select("id", "seq", "user", "ts", "embedding")
    rows = semantic_deviation(log, dims=fx.DIMS, keep=("id",), largest=fx.busiest(spark, sf))
    return fx.rounded(rows, "semantic_deviation")


def _vectors(spark, sf):
    return fx.activity(spark, sf, embedding=True).select("id", "day", "embedding")


def _gram_rows(moments):
    """One row per element pair, upper half."""
    return moments.select(
        F.col("day").cast("string").alias("day"), F.col("i").cast("bigint").alias("i"), "n",
        F.round("total", 5).alias("total"), F.posexplode("gram").alias("j", "value"),
    ).filter("j >= i").select("day", "i", F.col("j").cast("bigint").alias("j"), "n", "total", F.round("value", 5).alias("value"))


def vector_moments(spark, sf):
    return _gram_rows(batch_vector_moments(_vectors(spark, sf), "day", "embedding"))


MOMENT_ROWS = f"""vv AS (SELECT day, list_transform(x, lambda e: CAST(e AS DOUBLE)) AS x FROM vec), moments AS (
SELECT v.day, a.i, b.j, count(*) AS n, sum(v.x[a.i + 1]) AS total, sum(v.x[a.i + 1] * v.x[b.j + 1]) AS value
FROM vv v, (SELECT unnest(range(0, {sql.DIMS})) AS i) a, (SELECT unnest(range(0, {sql.DIMS})) AS j) b
WHERE b.j >= a.i GROUP BY v.day, a.i, b.j)"""


def prefix_moments(spark, sf):
    vectors = _vectors(spark, sf)
    dims = vector_dims(vectors, "embedding")
    moments = batch_vector_moments(vectors, "day", "embedding", dims)
    return _gram_rows(causal_batch_moments(moments, "day", dims, COMPONENTS))


PREFIX_SQL = f"""WITH {sql.ACT}, {sql.VECTORS}, {MOMENT_ROWS}, learn AS (
SELECT day, i, j, CASE WHEN n >= {COMPONENTS} THEN n END AS n, CASE WHEN n >= {COMPONENTS} THEN total END AS total,
  CASE WHEN n >= {COMPONENTS} THEN value END AS value FROM moments)
SELECT CAST(day AS VARCHAR) AS day, i, j, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS n,
  round(coalesce(sum(total) OVER w, 0), 5) AS total, round(coalesce(sum(value) OVER w, 0), 5) AS value
FROM learn WINDOW w AS (PARTITION BY i, j ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def reduced(spark, sf):
    """The causal components of every event, with one batch per day."""
    rows = causal_pca(_vectors(spark, sf), "day", "embedding", COMPONENTS)
    return rows.select(
        "id", F.col("day").cast("string").alias("day"),
        *[F.round(F.col("embed_pc")[i], 5).alias(f"pc_{i}") for i in range(COMPONENTS)],
    )


def component_lengths(spark, sf):
    """With as many components as elements, a row's components are as long as its way from the mean of earlier days."""
    rows = causal_pca(_vectors(spark, sf), "day", "embedding", fx.DIMS, dims=fx.DIMS, least=COMPONENTS)
    length = F.aggregate("embed_pc", F.lit(0.0), lambda total, v: total + v * v)
    return rows.select("id", F.col("day").cast("string").alias("day"), F.round(length, 5).alias("squared_length"))


LENGTH_SQL = f"""WITH {sql.ACT}, {sql.VECTORS}, elements AS (
SELECT id, day, a.i, CAST(x[a.i + 1] AS DOUBLE) AS v FROM vec, (SELECT unnest(range(0, {sql.DIMS})) AS i) a),
days AS (SELECT day, i, count(*) AS n, sum(v) AS total FROM elements GROUP BY day, i),
earlier AS (SELECT day, i, sum(total) FILTER (n >= {COMPONENTS}) OVER w / sum(n) FILTER (n >= {COMPONENTS}) OVER w AS mean
  FROM days WINDOW w AS (PARTITION BY i ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT e.id, CAST(e.day AS VARCHAR) AS day, round(sum((v - mean) * (v - mean)), 5) AS squared_length
FROM elements e JOIN earlier m ON m.day = e.day AND m.i = e.i GROUP BY e.id, e.day"""


def feature_table(spark, sf):
    """Metadata, deviation, causal components and label of every event."""
    log = fx.activity(spark, sf, embedding=True).drop("is_malicious")
    labelled = lab.flag_labels(log, fx.label_rows(spark, sf))
    meta = activity_features(labelled, fx.DOMAIN, keep=("id", "seq", "ts", "day", "user", "is_malicious", "embedding"))
    full = materialize(semantic_deviation(meta, dims=fx.DIMS), "feature-rows")
    rows = causal_pca(full, "day", "embedding", COMPONENTS)
    return rows.select(
        "id", F.col("day").cast("string").alias("day"), "user", "size", "attachment_count",
        "n_recipients_internal", "n_recipients_external", "has_external_recipient", "hour_of_day",
        "is_after_hours", "is_weekend", F.round("semantic_deviation", 6).alias("semantic_deviation"),
        *[F.round(F.col("embed_pc")[i], 5).alias(f"embed_pc_{i}") for i in range(COMPONENTS)], "is_malicious",
    )


# --- static model -----------------------------------------------------------
ALL = [*C.NUMERIC_FEATURES, *C.RARITY_FEATURES]


def _train(spark, sf):
    train, _ = split_by_time(fx.features(spark, sf), fx.TRAIN_END)
    return train


def user_moments(spark, sf):
    users = anomaly.user_moments(_train(spark, sf), ALL)
    return users.select(
        "user",
        *[F.col(f"{c}__n").alias(f"{c}_n") for c in ALL],
        *[F.round(f"{c}__mean", 6).alias(f"{c}_mean") for c in ALL],
        *[F.round(anomaly.deviation_of(F.col(f"{c}__var"), C.VARIANCE_FLOOR), 6).alias(f"{c}_std") for c in ALL],
    )


def global_moments(spark, sf):
    overall = anomaly.pooled_moments(anomaly.user_moments(_train(spark, sf), ALL), ALL)
    return overall.select(
        *[F.col(f"{c}__gn").alias(f"{c}_n") for c in ALL],
        *[F.round(f"{c}__gmean", 6).alias(f"{c}_mean") for c in ALL],
        *[F.round(anomaly.deviation_of(F.col(f"{c}__gvar"), C.VARIANCE_FLOOR), 6).alias(f"{c}_std") for c in ALL],
    )


def _moment_columns(suffix: str) -> str:
    return ", ".join(
        f"{c}__{suffix}n AS {c}_n, round({c}__{suffix}mean, 6) AS {c}_mean, "
        f"round(sqrt(greatest({c}__{suffix}var, 0.001)), 6) AS {c}_std" for c in ALL
    )


def static_scores(spark, sf):
    return fx.rounded(fx.scores(spark, sf), "numeric_anomaly", "rarity_anomaly", "risk_score").select(
        "id", F.col("day").cast("string").alias("day"), "user", "is_malicious",
        "numeric_anomaly", "rarity_anomaly", "risk_score", "uses_global_fallback",
    )


def _daily_top(scores, budgets=None):
    return capacity.top_by_budget(scores, "risk_score", budgets or fx.BUDGETS, by="day")


def daily_topk(spark, sf):
    return fx.day_text(_daily_top(fx.written_scores(spark, sf)).select("day", "budget", "id"))


def review_queue(spark, sf):
    """The flagship: the daily review queue of the static model at a 5% budget."""
    top = _daily_top(fx.written_scores(spark, sf), [0.05])
    return fx.day_text(fx.rounded(top, "risk_score").select("day", "id", "user", "is_malicious", "risk_score"))


def global_topk(spark, sf):
    top = capacity.top_by_budget(fx.written_scores(spark, sf), "risk_score", fx.BUDGETS)
    return top.select("budget", "id")


def threshold_hits(spark, sf):
    scores = fx.written_scores(spark, sf)
    above = capacity.above_threshold(scores, "risk_score", fx.BUDGETS)
    return lab.scenario_hits(lab.attach_scenario(above, fx.label_rows(spark, sf)), "budget")


def scenario_hits(spark, sf):
    top = _daily_top(fx.written_scores(spark, sf), [0.05])
    return lab.scenario_hits(lab.attach_scenario(top, fx.label_rows(spark, sf)))


def static_daily_scenarios(spark, sf):
    top = _daily_top(fx.written_scores(spark, sf))
    return lab.scenario_hits(lab.attach_scenario(top, fx.label_rows(spark, sf)), "budget")


def static_daily(spark, sf, scores=None):
    scores = scores if scores is not None else fx.written_scores(spark, sf)
    return capacity.daily_metrics(_daily_top(scores), scores)


def static_daily_metrics(spark, sf):
    return fx.day_text(static_daily(spark, sf).select(
        "day", "budget", "emails", "reviewed", "true_positives", "available_malicious"
    ))


SUMMARY = ["budget", "n_test", "n_reviewed", "true_positives", "available_malicious",
           "precision", "recall", "false_positive_rate"]


def static_daily_summary(spark, sf):
    summary = capacity.run_summary(static_daily(spark, sf)).select(*SUMMARY)
    return fx.rounded(summary, "precision", "recall", "false_positive_rate")


def global_budget_metrics(spark, sf):
    scores = fx.written_scores(spark, sf)
    top = capacity.top_by_budget(scores, "risk_score", fx.BUDGETS)
    return fx.rounded(capacity.global_budget_metrics(top, scores), "precision", "recall", "false_positive_rate")


GLOBAL_SQL = f"""WITH {sql.STATIC_GLOBAL}, pop AS (SELECT count(*) AS n, sum(is_malicious) AS p FROM scores),
m AS (SELECT budget, count(*) AS k, sum(is_malicious) AS tp FROM top GROUP BY budget)
SELECT budget, k AS n_reviewed, CAST(tp AS BIGINT) AS true_positives, round(tp / k::DOUBLE, 6) AS precision,
  round(tp / nullif(p, 0)::DOUBLE, 6) AS recall, round((k - tp) / greatest(n - p, 1)::DOUBLE, 6) AS false_positive_rate
FROM m, pop"""

QUERIES = {
    "semantic_deviation": (deviation, f"""WITH {sql.ACT}, {sql.VECTORS}, {sql.DEVIATION}
        SELECT id, round(semantic_deviation, 6) AS semantic_deviation FROM dev"""),
    "batch_vector_moments": (vector_moments, f"""WITH {sql.ACT}, {sql.VECTORS}, {MOMENT_ROWS}
        SELECT CAST(day AS VARCHAR) AS day, i, j, n, round(total, 5) AS total, round(value, 5) AS value FROM moments"""),
    "causal_batch_moments": (prefix_moments, PREFIX_SQL),
    "causal_pca": (reduced, None),
    "component_lengths": (component_lengths, LENGTH_SQL),
    "feature_table": (feature_table, None),
    "user_moments": (user_moments, f"""WITH {sql.BASE}, {sql.TRAIN}, {sql.USERS}
        SELECT "user", {_moment_columns('')} FROM users"""),
    "global_moments": (global_moments, f"""WITH {sql.BASE}, {sql.TRAIN}, {sql.OVERALL}
        SELECT {_moment_columns('g')} FROM overall"""),
    "static_anomaly_scores": (static_scores, f"""WITH {sql.STATIC}
        SELECT id, CAST(day AS VARCHAR) AS day, "user", is_malicious, round(numeric_anomaly, 6) AS numeric_anomaly,
          round(rarity_anomaly, 6) AS rarity_anomaly, round(risk_score, 6) AS risk_score, uses_global_fallback
        FROM scores"""),
    "daily_review_queue": (review_queue, f"""WITH {sql.STATIC_DAILY}
        SELECT CAST(day AS VARCHAR) AS day, id, "user", is_malicious, round(risk_score, 6) AS risk_score
        FROM top WHERE budget = CAST(0.05 AS DOUBLE)"""),
    "daily_topk": (daily_topk, f"WITH {sql.STATIC_DAILY} SELECT CAST(day AS VARCHAR) AS day, budget, id FROM top"),
    "global_topk": (global_topk, f"WITH {sql.STATIC_GLOBAL} SELECT budget, id FROM top"),
    "threshold_hits": (threshold_hits, f"""WITH {sql.STATIC_GLOBAL},
        edge AS (SELECT budget, min(round(risk_score, 9)) AS t FROM top GROUP BY budget)
        SELECT e.budget, s.scenario, count(*) AS true_positives FROM scores s JOIN edge e ON round(s.risk_score, 9) >= e.t
        WHERE s.is_malicious = 1 GROUP BY e.budget, s.scenario"""),
    "scenario_hits": (scenario_hits, f"""WITH {sql.STATIC_DAILY} SELECT scenario, count(*) AS true_positives
        FROM top WHERE is_malicious = 1 AND budget = CAST(0.05 AS DOUBLE) GROUP BY scenario"""),
    "static_daily_scenarios": (static_daily_scenarios, f"""WITH {sql.STATIC_DAILY}
        SELECT budget, scenario, count(*) AS true_positives FROM top WHERE is_malicious = 1 GROUP BY budget, scenario"""),
    "static_daily_metrics": (static_daily_metrics, f"""WITH {sql.STATIC_DAILY}, {sql.daily_metrics('top', 'scores')}
        SELECT CAST(day AS VARCHAR) AS day, budget, emails, reviewed, true_positives, available_malicious FROM daily"""),
    "static_daily_summary": (static_daily_summary, f"""WITH {sql.STATIC_DAILY}, {sql.daily_metrics('top', 'scores')},
        {sql.run_summary('daily')} SELECT {', '.join(SUMMARY)} FROM summary"""),
    "global_budget_metrics": (global_budget_metrics, GLOBAL_SQL),
}
