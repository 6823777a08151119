"""The learning replay as SQL: a recursion over days that carries A and b as lists."""

from __future__ import annotations

from riskloom.plans.sql import BANDIT, CONTEXTS, N_CONTEXT, SCALER, STATIC

D = N_CONTEXT
ROWS = f"""bctx AS MATERIALIZED (
SELECT id, seq, "user", day, is_malicious, scenario, dense_rank() OVER (ORDER BY day) AS n,
  count(*) OVER (PARTITION BY day) AS rows_of_day, [{', '.join(f'x{i}' for i in range(D))}] AS x FROM ctx)"""
_UNIT = str([[float(i == j) for j in range(D)] for i in range(D)]) + "::DOUBLE[][]"


def policies(rows: list[tuple]) -> str:
    """``rows`` holds (policy, alpha, gain, budget)."""
    values = ", ".join(f"('{p}', {a!r}::DOUBLE, {g!r}::DOUBLE, {b!r}::DOUBLE)" for p, a, g, b in rows)
    return f"pol AS (SELECT * FROM (VALUES {values}) v(policy, alpha, gain, budget))"


def solved(source: str) -> str:
    """``source`` with the inverse ``inv`` of ``a`` and ``theta``, by eliminating one pivot per subquery.

    A is the unit matrix plus sums of x xT, so no pivot is smaller than one.
    """
    table = f"""(SELECT *, list_transform(a, lambda row, i: list_concat(row, ({_UNIT})[i])) AS m0 FROM {source})"""
    for p in range(1, D + 1):
        pivot = f"list_transform(m{p - 1}[{p}], lambda v: v / m{p - 1}[{p}][{p}])"
        table = f"(SELECT * EXCLUDE (m{p - 1}), m{p - 1}, {pivot} AS p{p} FROM {table})"
        rest = f"list_transform(row, lambda v, j: v - row[{p}] * p{p}[j])"
        table = (f"(SELECT * EXCLUDE (m{p - 1}, p{p}), list_transform(m{p - 1}, lambda row, i: "
                 f"CASE WHEN i = {p} THEN p{p} ELSE {rest} END) AS m{p} FROM {table})")
    table = f"(SELECT * EXCLUDE (m{D}), list_transform(m{D}, lambda row: row[{D + 1}:]) AS inv FROM {table})"
    return f"(SELECT *, list_transform(inv, lambda row: list_dot_product(row, b)) AS theta FROM {table})"


def scored(state: str) -> str:
    """Every row of a state's day with its score, its place and the day's slots."""
    bound = "list_dot_product(s.theta, c.x) + s.alpha * sqrt(list_dot_product(c.x, list_transform(s.inv, lambda row: list_dot_product(row, c.x))))"
    return f"""(SELECT *, row_number() OVER (PARTITION BY policy, n ORDER BY round(ucb_score, 9) DESC, seq) AS place
FROM (SELECT s.policy, s.gain, s.budget, s.n, s.a, s.b, s.alpha, c.id, c.seq, c."user", c.day, c.is_malicious, c.scenario, c.x,
    greatest(1, ceil(c.rows_of_day * s.budget)) AS slots, {bound} AS ucb_score
  FROM {state} s JOIN bctx c ON c.n = s.n))"""


_GRAM = "[" + ", ".join(
    "[" + ", ".join(f"sum(x[{min(i, j)}] * x[{max(i, j)}])" for j in range(1, D + 1)) + "]" for i in range(1, D + 1)) + "]"
_GAIN = "[" + ", ".join(f"sum(x[{i}] * CASE WHEN is_malicious = 1 THEN gain ELSE -1.0::DOUBLE END)" for i in range(1, D + 1)) + "]"
_STEP = f"""SELECT n + 1 AS n, policy, alpha, gain, budget,
  list_transform(a, lambda row, i: list_transform(row, lambda v, j: v + gram[i][j])) AS a,
  list_transform(b, lambda v, i: v + reward[i]) AS b
FROM (SELECT n, policy, any_value(alpha) AS alpha, any_value(gain) AS gain, any_value(budget) AS budget,
    any_value(a) AS a, any_value(b) AS b, {_GRAM} AS gram, {_GAIN} AS reward
  FROM {scored(solved('replay'))} WHERE place <= slots GROUP BY n, policy)"""
REPLAY = f"""replay AS (
SELECT 1::BIGINT AS n, policy, alpha, gain, budget, {_UNIT} AS a, {[0.0] * D}::DOUBLE[] AS b FROM pol
UNION ALL {_STEP}),
learnt AS MATERIALIZED (SELECT * EXCLUDE (a, b) FROM {scored(solved('replay'))}),
lqueue AS (SELECT * FROM learnt WHERE place <= slots)"""


def learnt(rows: list[tuple], static: bool = False) -> str:
    """CTEs up to ``learnt`` (all test rows with their scores, per policy) and ``lqueue`` (the reviewed ones)."""
    base = [STATIC, SCALER, CONTEXTS] if static else [BANDIT]
    return "RECURSIVE " + ", ".join([*base, ROWS, policies(rows), REPLAY])


#: Daily series of every policy.
DAILY = """ldaily AS (
SELECT q.policy, q.budget, q.day, v.emails, q.reviewed, q.tp AS true_positives, q.reviewed - q.tp AS false_positives,
  v.avail AS available_malicious, least(q.reviewed, v.avail) AS oracle_true_positives,
  q.tp * q.gain - (q.reviewed - q.tp) AS reward,
  least(q.reviewed, v.avail) * q.gain - (q.reviewed - least(q.reviewed, v.avail)) AS oracle_reward
FROM (SELECT policy, day, any_value(gain) AS gain, any_value(budget) AS budget, count(*) AS reviewed,
    CAST(sum(is_malicious) AS BIGINT) AS tp FROM lqueue GROUP BY policy, day) q
JOIN (SELECT day, count(*) AS emails, CAST(sum(is_malicious) AS BIGINT) AS avail FROM bctx GROUP BY day) v ON v.day = q.day)"""
