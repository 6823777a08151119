"""The same inputs as SQL, shared by the check queries."""

from __future__ import annotations

from riskloom import constants as C
from riskloom.plans.fixtures import CONTEXT, DIMS, EMBED_CONTEXT

ACT = r"""act AS (
SELECT event_id AS id, event_id AS seq, user_id AS "user", ts, CAST(ts AS DATE) AS day,
  event_type AS activity, value AS size, k,
  repeat('a@corp.example;', k % 3)
    || CASE WHEN k % 5 = 0 THEN 'x@ext.example' ELSE 'c@corp.example' END AS "to",
  CASE WHEN k % 2 = 0 THEN 'b@CORP.example' ELSE '' END AS cc, '' AS bcc,
  CASE WHEN k % 4 = 0 THEN repeat('C:\d\f.doc(10);', k % 3) || 'C:\d\g.doc(20)' ELSE '' END AS attachments,
  CASE WHEN event_type = 'error' AND k >= 95 THEN 1 ELSE 0 END AS is_malicious,
  CASE WHEN event_type = 'error' AND k >= 95 THEN 2 + k % 3 ELSE 0 END AS scenario
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

LABELS = """lab AS (
SELECT id, scenario, "user" AS insider_user FROM act WHERE is_malicious = 1
UNION ALL SELECT (SELECT min(id) FROM act) - i, 2, 0 FROM (VALUES (1), (2), (3)) v(i))"""


def items(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 ELSE length({c}) - length(replace({c}, ';', '')) + 1 END"


def internal(c: str) -> str:
    return rf"least(len(regexp_extract_all(lower({c}), '@corp\.example')), {items(c)})"


_TOTAL = " + ".join(items(c) for c in ('"to"', "cc", "bcc"))
_INTERNAL = " + ".join(internal(c) for c in ('"to"', "cc", "bcc"))

META = f"""meta AS (
SELECT id, seq, "user", ts, day, activity, is_malicious, scenario, size,
  CAST({items('attachments')} AS DOUBLE) AS attachment_count,
  CAST({_INTERNAL} AS DOUBLE) AS n_recipients_internal,
  CAST(({_TOTAL}) - ({_INTERNAL}) AS DOUBLE) AS n_recipients_external,
  CASE WHEN ({_TOTAL}) > ({_INTERNAL}) THEN 1 ELSE 0 END AS has_external_recipient,
  CAST(hour(ts) AS INTEGER) AS hour_of_day,
  CASE WHEN hour(ts) < 7 OR hour(ts) >= 18 THEN 1 ELSE 0 END AS is_after_hours,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM act)"""

VECTORS = """vec AS (
SELECT a.id, a."user", a.ts, a.seq, a.day, v.embedding AS x
FROM act a JOIN embeddings v ON v.vec_id = a.id % (SELECT count(*) FROM embeddings))"""

DEVIATION = f"""dev AS (
SELECT id, CASE WHEN count(h) > 0 AND sum(h * h) > 0 AND sum(xi * xi) > 0
    THEN 1 - sum(xi * h) / (sqrt(sum(xi * xi)) * sqrt(sum(h * h))) END AS semantic_deviation
FROM (SELECT id, i, xi, sum(xi) OVER (PARTITION BY "user", i ORDER BY ts, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h
      FROM (SELECT id, "user", ts, seq, r.i, CAST(x[r.i] AS DOUBLE) AS xi
            FROM vec, (SELECT unnest(range(1, {DIMS + 1})) AS i) r)) w
GROUP BY id)"""

_EMBED = ", ".join(f"CAST(v.x[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(EMBED_CONTEXT))
FEATURES = f"""feat AS (
SELECT m.*, d.semantic_deviation, {_EMBED}
FROM meta m JOIN dev d ON d.id = m.id JOIN vec v ON v.id = m.id)"""

BASE = ", ".join([ACT, META, VECTORS, DEVIATION, FEATURES])


def scaled(c: str, alias: str = "") -> str:
    c_ = f"{alias}{c}"
    return f"ln(1 + {c_})" if c in C.LOG_SCALED else c_


_ALL = [*C.NUMERIC_FEATURES, *C.RARITY_FEATURES]
_MOMENTS = ", ".join(
    f"count({scaled(c)}) AS {c}__n, avg({scaled(c)}) AS {c}__mean, var_pop({scaled(c)}) AS {c}__var"
    for c in _ALL
)
_POOLED = ", ".join(
    f"count({scaled(c)}) AS {c}__gn, avg({scaled(c)}) AS {c}__gmean, var_pop({scaled(c)}) AS {c}__gvar"
    for c in _ALL
)
TRAIN = "train AS (SELECT * FROM feat WHERE ts < DATE '2024-01-16')"
TEST = "test AS (SELECT * FROM feat WHERE ts >= DATE '2024-01-16')"
USERS = f'users AS (SELECT "user", {_MOMENTS} FROM train GROUP BY "user")'
OVERALL = f"overall AS (SELECT {_POOLED} FROM train)"


def _pick(c: str, part: str, ok: str) -> str:
    return f"CASE WHEN {ok} THEN {c}__{part} ELSE {c}__g{part} END"


def _z(c: str) -> str:
    value = scaled(c, "t.")
    mean, var = _pick(c, "mean", "ok"), _pick(c, "var", "ok")
    return f"CASE WHEN {value} IS NULL THEN 0 ELSE least(abs(({value} - ({mean})) / sqrt(greatest({var}, 0.001))), 6.0) END"


_OK = " AND ".join(f"coalesce(u.{c}__n >= 30, false)" for c in C.NUMERIC_FEATURES)
_OKR = " AND ".join(f"coalesce(u.{c}__n >= 30, false)" for c in C.RARITY_FEATURES)
_Z = " + ".join(f"({_z(c)})" for c in C.NUMERIC_FEATURES)
_NZ = " + ".join(f"(CASE WHEN {scaled(c, 't.')} IS NULL THEN 0 ELSE 1 END)" for c in C.NUMERIC_FEATURES)
_RARE = " + ".join(
    f"t.{c} * -ln(greatest({_pick(c, 'mean', 'okr')}, 0.001))" for c in C.RARITY_FEATURES
)
SCORES = f"""scores AS (
SELECT id, seq, "user", day, is_malicious, scenario, numeric_anomaly, rarity_anomaly,
  numeric_anomaly + 0.5 * rarity_anomaly AS risk_score, uses_global_fallback
FROM (
  SELECT t.id, t.seq, t."user", t.day, t.is_malicious, t.scenario,
    CASE WHEN ({_NZ}) > 0 THEN ({_Z}) / ({_NZ}) ELSE 0 END AS numeric_anomaly,
    {_RARE} AS rarity_anomaly, CASE WHEN ok THEN 0 ELSE 1 END AS uses_global_fallback
  FROM (SELECT t.*, u.* EXCLUDE ("user"), o.*, ({_OK}) AS ok, ({_OKR}) AS okr
        FROM test t LEFT JOIN users u ON u."user" = t."user" CROSS JOIN overall o) t))"""

STATIC = ", ".join([BASE, TRAIN, TEST, USERS, OVERALL, SCORES])

BUDGETS = """budgets AS (
SELECT CAST(b AS DOUBLE) AS budget FROM (VALUES (0.001), (0.005), (0.01), (0.05), (0.10)) v(b))"""


def daily_top(source: str, score: str, name: str, tie: str = "id") -> str:
    """Top quota per day and budget out of ``source``."""
    return f"""{name} AS (
SELECT b.budget, r.* EXCLUDE (rn, n) FROM (
  SELECT s.*, count(*) OVER (PARTITION BY day) AS n,
    row_number() OVER (PARTITION BY day ORDER BY round({score}, 9) DESC, {tie}) AS rn
  FROM {source} s) r, budgets b
WHERE rn <= greatest(1, ceil(n * b.budget)))"""


def global_top(source: str, score: str, name: str) -> str:
    return f"""{name} AS (
SELECT b.budget, r.* EXCLUDE (rn, n) FROM (
  SELECT s.*, count(*) OVER () AS n, row_number() OVER (ORDER BY round({score}, 9) DESC, id) AS rn
  FROM {source} s) r, budgets b
WHERE rn <= greatest(1, ceil(n * b.budget)))"""


STATIC_DAILY = ", ".join([STATIC, BUDGETS, daily_top("scores", "risk_score", "top")])
STATIC_GLOBAL = ", ".join([STATIC, BUDGETS, global_top("scores", "risk_score", "top")])

_SCALER = ", ".join(
    f"count({scaled(c)}) AS {c}__n, avg({scaled(c)}) AS {c}__mean, "
    f"sqrt(greatest(var_pop({scaled(c)}), 0.000001)) AS {c}__std"
    for c in CONTEXT
)
SCALER = f"scaler AS (SELECT count(*) AS n_train, {_SCALER} FROM train)"
_X = ", ".join(
    f"coalesce(({scaled(c, 't.')} - s.{c}__mean) / s.{c}__std, 0) AS x{i + 1}" for i, c in enumerate(CONTEXT)
)
CONTEXTS = f"""ctx AS (
SELECT t.id, t.seq, t."user", t.day, t.is_malicious, t.scenario, 1.0::DOUBLE AS x0, {_X}
FROM test t CROSS JOIN scaler s)"""
N_CONTEXT = len(CONTEXT) + 1
BANDIT = ", ".join([BASE, TRAIN, TEST, SCALER, CONTEXTS])


def daily_metrics(top: str, population: str, name: str = "daily") -> str:
    return f"""{name} AS (
SELECT r.day, r.budget, v.emails, r.reviewed, r.true_positives, r.reviewed - r.true_positives AS false_positives,
  v.available_malicious, least(r.reviewed, v.available_malicious) AS oracle_true_positives,
  r.true_positives * 10.0 - (r.reviewed - r.true_positives) * 1.0 AS reward,
  least(r.reviewed, v.available_malicious) * 10.0
    - (r.reviewed - least(r.reviewed, v.available_malicious)) * 1.0 AS oracle_reward
FROM (SELECT day, budget, count(*) AS reviewed, CAST(sum(is_malicious) AS BIGINT) AS true_positives
      FROM {top} GROUP BY day, budget) r
JOIN (SELECT day, count(*) AS emails, CAST(sum(is_malicious) AS BIGINT) AS available_malicious
      FROM {population} GROUP BY day) v ON v.day = r.day)"""


def run_summary(daily: str, name: str = "summary") -> str:
    return f"""{name} AS (
SELECT budget, count(*) AS n_days, CAST(sum(emails) AS BIGINT) AS n_test,
  CAST(sum(reviewed) AS BIGINT) AS n_reviewed, CAST(sum(true_positives) AS BIGINT) AS true_positives,
  CAST(sum(available_malicious) AS BIGINT) AS available_malicious,
  CAST(sum(oracle_true_positives) AS BIGINT) AS oracle_true_positives,
  round(sum(true_positives) / nullif(sum(reviewed), 0)::DOUBLE, 6) AS precision,
  round(sum(true_positives) / nullif(sum(available_malicious), 0)::DOUBLE, 6) AS recall,
  round(sum(false_positives) / greatest(sum(emails) - sum(available_malicious), 1)::DOUBLE, 6) AS false_positive_rate,
  CAST(sum(reward) AS DOUBLE) AS cumulative_reward, CAST(sum(oracle_reward) AS DOUBLE) AS oracle_reward,
  CAST(sum(oracle_reward) - sum(reward) AS DOUBLE) AS cumulative_regret
FROM {daily} GROUP BY budget)"""


# The hybrid queue: 5% static and 5% adaptive under a daily target of 10%.
STATIC_SHARE, TARGET = 0.05, 0.10
# Follows the static scores and the learnt queue.
MERGED = ", ".join([
    """quota AS (
SELECT day, greatest(1, ceil(count(*) * CAST(0.10 AS DOUBLE))) AS target,
  greatest(1, ceil(count(*) * CAST(0.05 AS DOUBLE))) AS share FROM scores GROUP BY day)""",
    """sranked AS (
SELECT s.*, q.target, q.share,
  row_number() OVER (PARTITION BY s.day ORDER BY round(risk_score, 9) DESC, seq) AS srank
FROM scores s JOIN quota q ON q.day = s.day)""",
    """aqueue AS (
SELECT day, id, seq, is_malicious, scenario, ucb_score FROM lqueue WHERE budget = CAST(0.05 AS DOUBLE))""",
    """extra AS (
SELECT a.*, row_number() OVER (PARTITION BY a.day ORDER BY a.seq) AS pos
FROM aqueue a ANTI JOIN (SELECT day, id FROM sranked WHERE srank <= share) s
  ON s.day = a.day AND s.id = a.id)""",
    """head AS (
SELECT day, id, is_malicious, scenario, 'Static baseline' AS selection_source FROM sranked WHERE srank <= share
UNION ALL SELECT e.day, e.id, e.is_malicious, e.scenario, 'LinUCB' FROM extra e JOIN quota q ON q.day = e.day
WHERE e.pos <= q.target - q.share)""",
    """rest AS (
SELECT s.*, row_number() OVER (PARTITION BY s.day ORDER BY srank) AS rrank
FROM sranked s ANTI JOIN head h ON h.day = s.day AND h.id = s.id)""",
    """queue AS (
SELECT * FROM head
UNION ALL SELECT r.day, r.id, r.is_malicious, r.scenario, 'Static baseline fill'
FROM rest r JOIN (SELECT day, count(*) AS used FROM head GROUP BY day) u ON u.day = r.day
WHERE r.rrank <= r.target - u.used)""",
])
