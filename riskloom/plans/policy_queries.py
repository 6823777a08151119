"""The bandit, merged queues and policy comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.operators import bandit, bootstrap, capacity, compare, queues
from riskloom.operators import labels as lab
from riskloom.operators.features import split_by_time
from riskloom.plans import fixtures as fx
from riskloom.plans import learnt_sql as ls
from riskloom.plans import sql
from riskloom.session import materialize

REPLAY_BUDGET = 0.05
#: The replay reads one day at a time, so a day has to be several tasks' work.
CONTEXT_ROW_GROUP = 8 << 20
N = sql.N_CONTEXT


# --- contexts ---------------------------------------------------------------
def context_scaler(spark, sf):
    train, _ = split_by_time(fx.features(spark, sf, vector=True), fx.TRAIN_END)
    rows = bandit.scaler_table(train, C.BASE_CONTEXT, vector="embedding", dims=fx.DIMS)
    return fx.rounded(rows, "mean", "std")


def scaled_context(spark, sf):
    rows = fx.contexts(spark, sf)
    return rows.select("id", *[F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(N)])


def _written_contexts(spark, sf, feats=None):
    rows = fx.contexts(spark, sf, feats, by_day=True)
    return materialize(rows, "contexts", ["day"], arranged=True, row_group=CONTEXT_ROW_GROUP)


# --- the learning replay ----------------------------------------------------
def bandit_scores(spark, sf):
    """Scores of all test rows, each by the model that has learnt from the days before."""
    replay = bandit.bandit_replay(_written_contexts(spark, sf), budget=REPLAY_BUDGET, keep_scores=True)
    return replay.scores.select("id", "policy", F.round("ucb_score", 5).alias("ucb_score"))


def bandit_update(spark, sf):
    """What every day's reviews add to the model: the sums of x xT and of reward times x."""
    queue = bandit.bandit_replay(_written_contexts(spark, sf), budget=REPLAY_BUDGET).queue
    sums = bandit.update_sums(queue, N, by=("policy", "day"))
    return fx.day_text(sums).select(
        "policy", "day", F.col("i").cast("bigint").alias("i"), F.posexplode("v").alias("j", "value")
    ).select("policy", "day", "i", F.col("j").cast("bigint").alias("j"), F.round("value", 4).alias("value"))


def bandit_daily(spark, sf):
    replay = bandit.bandit_replay(_written_contexts(spark, sf), budget=REPLAY_BUDGET)
    return fx.day_text(replay.daily)


def policy_grid_daily(spark, sf):
    """The published policies, day by day."""
    replay = bandit.bandit_replay(_written_contexts(spark, sf), bandit.policy_grid(), REPLAY_BUDGET)
    return fx.day_text(replay.daily)


def policy_grid(spark, sf):
    policies = bandit.policy_grid()
    replay = bandit.bandit_replay(_written_contexts(spark, sf), policies, REPLAY_BUDGET)
    summary = capacity.run_summary(replay.daily, ("policy",))
    labels = fx.label_rows(spark, sf)
    hits = lab.scenario_hits(lab.attach_scenario(replay.queue, labels), "policy")
    table = bandit.sensitivity_table(replay, policies, summary, hits, labels)
    return fx.rounded(table, "precision", "recall", "false_positive_rate")


ONE = [("default", 1.0, 10.0, REPLAY_BUDGET)]
GRID = [(name, alpha, reward, REPLAY_BUDGET) for name, alpha, reward in C.POLICY_GRID]
_DAILY = """policy, CAST(day AS VARCHAR) AS day, emails, reviewed, true_positives, false_positives, available_malicious,
  oracle_true_positives, reward, oracle_reward"""
DAILY_SQL = f"WITH {ls.learnt(ONE)}, {ls.DAILY} SELECT {_DAILY} FROM ldaily"
UPDATE_SQL = f"""WITH {ls.learnt(ONE)}, q AS (SELECT policy, day, x,
  list_append(x, 1.0::DOUBLE) AS y, CASE WHEN is_malicious = 1 THEN gain ELSE -1.0::DOUBLE END AS r FROM lqueue)
SELECT policy, CAST(day AS VARCHAR) AS day, i, j, round(sum(CASE WHEN j < {N} THEN x[i + 1] * y[j + 1] ELSE x[i + 1] * r END), 4) AS value
FROM q, (SELECT unnest(range(0, {N})) AS i) a, (SELECT unnest(range(0, {N + 1})) AS j) b GROUP BY policy, day, i, j"""
GRID_SQL = f"""WITH {ls.learnt(GRID)}, {ls.DAILY}, {sql.run_summary('(SELECT * REPLACE (policy AS budget) FROM ldaily)')}, {sql.LABELS},
hit AS (SELECT policy, coalesce(l.scenario, 0) AS scenario, count(*) AS tp FROM lqueue q LEFT JOIN lab l ON l.id = q.id
  WHERE q.is_malicious = 1 GROUP BY ALL),
kinds AS (SELECT DISTINCT scenario FROM lab UNION SELECT scenario FROM hit)
SELECT s.* EXCLUDE (budget), p.policy, p.alpha, p.gain AS true_positive_reward, 1.0::DOUBLE AS review_cost,
  CAST(k.scenario AS INTEGER) AS scenario, coalesce(h.tp, 0) AS scenario_true_positives
FROM summary s JOIN pol p ON p.policy = s.budget CROSS JOIN kinds k
LEFT JOIN hit h ON h.policy = p.policy AND h.scenario = k.scenario"""


# --- one learnt run per capacity --------------------------------------------
def _arm(budget):
    return bandit.Policy(f"capacity {budget}", budget=budget)


ARMS = [(f"capacity {b}", 1.0, 10.0, b) for b in fx.BUDGETS]


def _learnt(spark, sf, budgets, feats=None):
    """(reviewed rows, daily series, contexts) of one run per budget, all in one replay."""
    policies = [_arm(b) for b in budgets]
    contexts = _written_contexts(spark, sf, feats)
    replay = bandit.bandit_replay(contexts, policies)
    return (bandit.with_budgets(replay.queue.drop("x"), policies).drop("policy"),
            materialize(bandit.with_budgets(replay.daily, policies).drop("policy"), "learnt-daily"), contexts)


def policy_daily_reward(spark, sf):
    return fx.day_text(_learnt(spark, sf, fx.BUDGETS)[1])


def policy_run_summary(spark, sf):
    """A run's summary with its settings: exploration, ridge, reward, cost, and the rows its scaler saw."""
    feats = fx.features(spark, sf, vector=True)
    summary = capacity.run_summary(_learnt(spark, sf, fx.BUDGETS, feats)[1])
    train, _ = split_by_time(feats, fx.TRAIN_END)
    arm = bandit.Policy()
    settings = {"alpha": arm.alpha, "ridge": 1.0, "true_positive_reward": arm.reward, "review_cost": arm.cost}
    summary = summary.withColumns({k: F.lit(v) for k, v in settings.items()}).withColumn("n_train", F.lit(train.count()))
    return fx.rounded(summary, "precision", "recall", "false_positive_rate")


def cumulative_regret(spark, sf):
    return fx.day_text(capacity.cumulative_regret(_learnt(spark, sf, fx.BUDGETS)[1]))


ARM_METRICS = f"{ls.learnt(ARMS)}, {ls.DAILY}"


# --- merged queue -----------------------------------------------------------
METHODS = {"static": "Static anomaly baseline", "learnt": "LinUCB", "merged": "Coverage-balanced hybrid"}


def _merged(spark, sf, scores=None, adaptive=None):
    """The queue merged from the static scores and the rows that the learnt policy reviewed at its share."""
    if scores is None:
        feats = fx.features(spark, sf, vector=True)
        scores = fx.written_scores(spark, sf, feats)
        adaptive = _learnt(spark, sf, [sql.STATIC_SHARE], feats)[0]
    adaptive = adaptive.filter(F.col("budget") == sql.STATIC_SHARE).select("day", "id", "seq", "user", "is_malicious", "ucb_score")
    rows = scores.select("day", "id", "seq", "user", "is_malicious", "risk_score")
    queue = queues.merge_queues(rows, adaptive, sql.TARGET, sql.STATIC_SHARE, sql.STATIC_SHARE)
    return queue, adaptive, scores


def hybrid_queue(spark, sf):
    return fx.day_text(_merged(spark, sf)[0].select("day", "id", "is_malicious", "selection_source"))


def hybrid_summary(spark, sf):
    summary = queues.merged_summary(*_merged(spark, sf))
    return fx.rounded(summary, "precision", "recall", "false_positive_rate")


HYBRID = f"{ls.learnt(ARMS, static=True)}, {sql.MERGED}"
HYBRID_SUMMARY = """hsum AS (
SELECT p.n AS n_test, q.k AS n_reviewed, CAST(q.tp AS BIGINT) AS true_positives,
  CAST(p.pos AS BIGINT) AS available_malicious, round(q.tp / q.k::DOUBLE, 6) AS precision,
  round(q.tp / nullif(p.pos, 0)::DOUBLE, 6) AS recall,
  round((q.k - q.tp) / greatest(p.n - p.pos, 1)::DOUBLE, 6) AS false_positive_rate,
  q.s AS static_initial_selection, (SELECT count(*) FROM aqueue) AS linucb_initial_selection,
  (SELECT count(*) FROM aqueue) - (SELECT count(*) FROM extra) AS overlap_removed, q.f AS static_fill_selection
FROM (SELECT count(*) AS k, sum(is_malicious) AS tp, count(*) FILTER (selection_source = 'Static baseline') AS s,
        count(*) FILTER (selection_source = 'Static baseline fill') AS f FROM queue) q,
  (SELECT count(*) AS n, sum(is_malicious) AS pos FROM scores) p)"""


# --- comparison -------------------------------------------------------------
def _arms(spark, sf):
    """Scores, static selections, learnt selections with their daily series, and the merged queue's parts."""
    feats = fx.features(spark, sf, vector=True)
    scores = fx.written_scores(spark, sf, feats)
    queue, daily, _ = _learnt(spark, sf, fx.BUDGETS, feats)
    static = materialize(capacity.top_by_budget(scores, "risk_score", fx.BUDGETS, by="day"), "static-top")
    return scores, static, queue, daily, _merged(spark, sf, scores, queue)


def policy_comparison(spark, sf):
    scores, static, _, daily, merged = _arms(spark, sf)
    hybrid = queues.merged_summary(*merged).withColumn("budget", F.lit(sql.TARGET))
    table = compare.compare_policies([
        compare.static_rows(None, capacity.run_summary(capacity.daily_metrics(static, scores))),
        compare.policy_rows(capacity.run_summary(daily), METHODS["learnt"], True),
        compare.policy_rows(hybrid, METHODS["merged"]),
    ])
    return fx.rounded(table, "precision", "recall", "false_positive_rate")


COMPARISON_SQL = f"""WITH {HYBRID}, {HYBRID_SUMMARY}, {sql.BUDGETS}, {ls.DAILY},
{sql.daily_top('scores', 'risk_score', 'stop')}, {sql.daily_metrics('stop', 'scores', 'sdaily')},
{sql.run_summary('sdaily', 'ssum')}, {sql.run_summary('ldaily', 'asum')}
SELECT 'Static anomaly baseline' AS method, budget, n_reviewed, true_positives, precision, recall,
  false_positive_rate, CAST(NULL AS DOUBLE) AS cumulative_regret FROM ssum
UNION ALL SELECT 'LinUCB', budget, n_reviewed, true_positives, precision, recall, false_positive_rate, cumulative_regret FROM asum
UNION ALL SELECT 'Coverage-balanced hybrid', CAST(0.10 AS DOUBLE), n_reviewed, true_positives, precision, recall,
  false_positive_rate, NULL FROM hsum"""


def global_comparison(spark, sf):
    """The comparison where the static method ran under one global budget: the rows above each threshold."""
    scores, _, _, daily, merged = _arms(spark, sf)
    hybrid = queues.merged_summary(*merged).withColumn("budget", F.lit(sql.TARGET))
    above = materialize(capacity.above_threshold(scores, "risk_score", fx.BUDGETS), "static-above")
    table = compare.compare_policies([
        compare.static_rows(capacity.global_budget_metrics(above, scores).withColumn("cumulative_regret", F.lit(None))),
        compare.policy_rows(capacity.run_summary(daily), METHODS["learnt"], True),
        compare.policy_rows(hybrid, METHODS["merged"]),
    ])
    return fx.rounded(table, "precision", "recall", "false_positive_rate")


GLOBAL_COMPARISON_SQL = COMPARISON_SQL.replace(
    f"{sql.daily_top('scores', 'risk_score', 'stop')}, {sql.daily_metrics('stop', 'scores', 'sdaily')},\n{sql.run_summary('sdaily', 'ssum')}",
    f"""{sql.global_top('scores', 'risk_score', 'gtop')},
edge AS (SELECT budget, min(round(risk_score, 9)) AS t FROM gtop GROUP BY budget),
ssum AS (SELECT budget, count(*) AS n_reviewed, CAST(sum(is_malicious) AS BIGINT) AS true_positives,
  round(sum(is_malicious) / count(*)::DOUBLE, 6) AS precision,
  round(sum(is_malicious) / nullif((SELECT sum(is_malicious) FROM scores), 0)::DOUBLE, 6) AS recall,
  round((count(*) - sum(is_malicious)) / greatest((SELECT count(*) - sum(is_malicious) FROM scores), 1)::DOUBLE, 6) AS false_positive_rate
  FROM edge JOIN scores ON round(risk_score, 9) >= t GROUP BY budget)""")


def scenario_coverage(spark, sf):
    """Recall by scenario of every method, the merged queue included."""
    _, static, queue, _, merged = _arms(spark, sf)
    labels = fx.activity(spark, sf).filter("is_malicious = 1").select("id", "scenario")
    columns = ["id", "is_malicious", "budget"]
    tops = (
        static.select(*columns).withColumn("method", F.lit(METHODS["static"]))
        .unionByName(queue.select(*columns).withColumn("method", F.lit(METHODS["learnt"])))
        .unionByName(merged[0].withColumn("budget", F.lit(sql.TARGET)).select(*columns).withColumn("method", F.lit(METHODS["merged"])))
    )
    hits = lab.scenario_hits(lab.attach_scenario(tops, labels), "method", "budget")
    runs = tops.select("method", "budget").distinct()
    return fx.rounded(compare.scenario_coverage(runs, hits, labels), "scenario_recall")


COVERAGE_SQL = f"""WITH {HYBRID}, {sql.BUDGETS}, {sql.daily_top('scores', 'risk_score', 'stop')},
tops AS (SELECT 'Static anomaly baseline' AS method, budget, scenario, is_malicious FROM stop
  UNION ALL SELECT 'LinUCB', budget, scenario, is_malicious FROM lqueue
  UNION ALL SELECT 'Coverage-balanced hybrid', CAST(0.10 AS DOUBLE), scenario, is_malicious FROM queue),
tot AS (SELECT scenario, count(*) AS n FROM act WHERE is_malicious = 1 GROUP BY scenario),
hit AS (SELECT method, budget, scenario, count(*) AS tp FROM tops WHERE is_malicious = 1 GROUP BY ALL)
SELECT r.method, r.budget, tot.scenario, tot.n AS malicious_emails_in_scenario, coalesce(hit.tp, 0) AS true_positives,
  round(coalesce(hit.tp, 0) / tot.n::DOUBLE, 6) AS scenario_recall
FROM (SELECT DISTINCT method, budget FROM tops) r CROSS JOIN tot
LEFT JOIN hit ON hit.method = r.method AND hit.budget = r.budget AND hit.scenario = tot.scenario"""


def hybrid_scenarios(spark, sf):
    """Hits of the merged queue by scenario and by the list they came from."""
    queue = _merged(spark, sf)[0]
    labels = fx.activity(spark, sf).filter("is_malicious = 1").select("id", "scenario")
    return lab.scenario_hits(lab.attach_scenario(queue, labels), "selection_source")


# --- paired comparison ------------------------------------------------------
def _pair(spark, sf):
    feats = fx.features(spark, sf, vector=True)
    scores = fx.written_scores(spark, sf, feats)
    static = capacity.top_by_budget(scores, "risk_score", [REPLAY_BUDGET], by="day")
    return (
        materialize(capacity.daily_metrics(static, scores), "static-daily"),
        _learnt(spark, sf, [REPLAY_BUDGET], feats)[1],
    )


def paired_day_difference(spark, sf):
    return fx.day_text(bootstrap.paired_day_difference(*_pair(spark, sf)))


def bootstrap_interval(spark, sf):
    return bootstrap.paired_bootstrap(*_pair(spark, sf))


PAIRED = f"""{ls.learnt(ONE, static=True)}, {sql.BUDGETS}, {sql.daily_top('scores', 'risk_score', 'stop')},
pair AS (
SELECT s.day, s.tp AS value_a, a.tp AS value_b, a.tp - s.tp AS difference
FROM (SELECT day, CAST(sum(is_malicious) AS BIGINT) AS tp FROM stop WHERE budget = CAST(0.05 AS DOUBLE) GROUP BY day) s
JOIN (SELECT day, CAST(sum(is_malicious) AS BIGINT) AS tp FROM lqueue GROUP BY day) a ON a.day = s.day)"""
BOOTSTRAP_SQL = f"""WITH {PAIRED}, num AS (SELECT difference, row_number() OVER (ORDER BY day) - 1 AS at FROM pair),
draws AS (SELECT r.i AS rep, p.i AS pos,
  CAST('0x' || substr(md5('{bootstrap.SEED}:' || r.i || ':' || p.i), 1, 8) AS BIGINT) % (SELECT count(*) FROM pair) AS at
FROM (SELECT unnest(range(0, {bootstrap.REPLICATES})) AS i) r, (SELECT unnest(range(0, (SELECT count(*) FROM pair))) AS i) p),
sums AS (SELECT rep, CAST(sum(difference) AS BIGINT) AS total FROM draws JOIN num ON num.at = draws.at GROUP BY rep)
SELECT (SELECT count(*) FROM pair) AS n_days, (SELECT CAST(sum(value_a) AS BIGINT) FROM pair) AS total_a,
  (SELECT CAST(sum(value_b) AS BIGINT) FROM pair) AS total_b,
  (SELECT CAST(sum(difference) AS BIGINT) FROM pair) AS difference,
  round(quantile_cont(total, 0.025), 2) AS ci_lower, round(quantile_cont(total, 0.975), 2) AS ci_upper,
  round(avg(CASE WHEN total > 0 THEN 1 ELSE 0 END), 4) AS probability_b_greater FROM sums"""

_SUMMARY = "budget, n_days, n_test, n_reviewed, true_positives, available_malicious, oracle_true_positives, " \
    "precision, recall, false_positive_rate, cumulative_reward, oracle_reward, cumulative_regret"

QUERIES = {
    "context_scaler": (context_scaler, f"WITH {sql.BASE}, {sql.TRAIN}, {sql.SCALER} " + " UNION ALL ".join(
        f"""SELECT n_train, '{c}' AS feature, {c}__n AS n, round({c}__mean, 6) AS mean, round({c}__std, 6) AS std FROM scaler"""
        for c in fx.CONTEXT)),
    "scaled_context": (scaled_context, f"""WITH {sql.BANDIT}
        SELECT id, {', '.join(f'round(x{i}, 6) AS x{i}' for i in range(N))} FROM ctx"""),
    "bandit_scores": (bandit_scores, f"WITH {ls.learnt(ONE)} SELECT id, policy, round(ucb_score, 5) AS ucb_score FROM learnt"),
    "bandit_update": (bandit_update, UPDATE_SQL),
    "bandit_daily": (bandit_daily, DAILY_SQL),
    "policy_grid_daily": (policy_grid_daily, f"WITH {ls.learnt(GRID)}, {ls.DAILY} SELECT {_DAILY} FROM ldaily"),
    "policy_grid": (policy_grid, GRID_SQL),
    "policy_daily_reward": (policy_daily_reward, f"""WITH {ARM_METRICS}
        SELECT budget, {_DAILY.removeprefix('policy, ')} FROM ldaily"""),
    "policy_run_summary": (policy_run_summary, f"""WITH {ARM_METRICS}, {sql.run_summary('ldaily')}
        SELECT {_SUMMARY}, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS ridge, 10.0::DOUBLE AS true_positive_reward,
          1.0::DOUBLE AS review_cost, (SELECT count(*) FROM train) AS n_train FROM summary"""),
    "cumulative_regret": (cumulative_regret, f"""WITH {ARM_METRICS}
        SELECT CAST(day AS VARCHAR) AS day, budget, CAST(sum(reward) OVER w AS DOUBLE) AS cumulative_reward,
          CAST(sum(oracle_reward - reward) OVER w AS DOUBLE) AS cumulative_regret FROM ldaily
        WINDOW w AS (PARTITION BY budget ORDER BY day ROWS UNBOUNDED PRECEDING)"""),
    "hybrid_queue": (hybrid_queue, f"""WITH {HYBRID}
        SELECT CAST(day AS VARCHAR) AS day, id, is_malicious, selection_source FROM queue"""),
    "hybrid_summary": (hybrid_summary, f"WITH {HYBRID}, {HYBRID_SUMMARY} SELECT * FROM hsum"),
    "policy_comparison": (policy_comparison, COMPARISON_SQL),
    "global_comparison": (global_comparison, GLOBAL_COMPARISON_SQL),
    "hybrid_scenarios": (hybrid_scenarios, f"""WITH {HYBRID} SELECT selection_source, scenario, count(*) AS true_positives
        FROM queue WHERE is_malicious = 1 GROUP BY ALL"""),
    "scenario_coverage": (scenario_coverage, COVERAGE_SQL),
    "paired_day_difference": (paired_day_difference, f"""WITH {PAIRED}
        SELECT CAST(day AS VARCHAR) AS day, value_a, value_b, difference FROM pair"""),
    "bootstrap_interval": (bootstrap_interval, BOOTSTRAP_SQL),
}
