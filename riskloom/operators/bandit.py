"""A daily contextual bandit that decides which events to review.

Every event of a day is scored with the model as it stood at the start of the day,
so a day is one distributed job and only days are sequential. The update is a sum
over the reviewed rows: after a day, A grows by the sum of x xT and b by the sum of
reward times x, and neither depends on row order. Per policy the driver keeps just
A and b, which are d x d and d numbers; rows stay on the executors.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskloom import constants as C
from riskloom.functions import scalars as S
from riskloom.functions.ordering import ACCURACY, Key, sort_numbers, take_in_order
from riskloom.functions.schemas import extended
from riskloom.functions.vectors import known_matrix, lists, matrix, vector_sum, with_column
from riskloom.operators.capacity import SCORE_PLACES, add_rewards, check_budgets
from riskloom.operators.semantic import VECTOR_ROWS_PER_TASK
from riskloom.session import fresh_path, materialize


#: On days of more rows contexts do not travel with the scores of all rows.
SMALL_DAY = 10_000


# --- contexts ---------------------------------------------------------------
@dataclass(frozen=True)
class Scaler:
    """Mean and deviation of every context column, and of every vector element, over the training rows."""

    n_train: int
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    vector: str | None = None
    vector_mean: tuple[float, ...] = ()
    vector_std: tuple[float, ...] = ()


def vector_table(train: DataFrame, vector: str, dims: int, prefix: str, floor: float = C.SCALER_FLOOR) -> DataFrame:
    """The rows of ``scaler_table`` for the elements of a vector; every task adds up its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square, rows = np.zeros(dims, np.int64), np.zeros(dims), np.zeros(dims), 0
        for part in batches:
            x = known_matrix(part.column("x"), dims)
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            n, total, square, rows = n + known.sum(axis=0), total + x.sum(axis=0), square + (x * x).sum(axis=0), rows + len(x)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.arange(dims, dtype=np.int32)), "rows": [rows] * dims, "n": n, "total": total, "square": square})

    parts = train.select(F.col(vector).alias("x")).mapInArrow(
        run, "i int, rows bigint, n bigint, total double, square double")
    sums = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "total", "square")])
    mean = S.ratio(F.col("total"), F.col("n"))
    variance = S.ratio(F.col("square"), F.col("n")) - mean * mean
    return sums.select(
        F.col("rows").alias("n_train"), F.concat(F.lit(prefix), F.col("i").cast("string")).alias("feature"), "n",
        mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(floor))).alias("std"))


def scaler_table(
    train: DataFrame, columns: list[str], floor: float = C.SCALER_FLOOR, vector: str | None = None, dims: int = 0,
    prefix: str = "embed_",
) -> DataFrame:
    """One row per context column and vector element, from aggregations without a key."""
    values = train.select(*[S.scaled_feature(c).alias(c) for c in columns])
    parts = [
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.sqrt(F.greatest(F.var_pop(c), F.lit(floor))).alias("std"),
        )
        for c in columns
    ]
    wide = values.agg(F.count(F.lit(1)).alias("n_train"), F.array(*parts).alias("rows"))
    rows = wide.select("n_train", F.explode("rows").alias("r")).select("n_train", "r.*")
    return rows.unionByName(vector_table(train, vector, dims, prefix, floor)) if vector else rows


def fit_scaler(
    train: DataFrame, columns: list[str], floor: float = C.SCALER_FLOOR, vector: str | None = None, dims: int = 0
) -> Scaler:
    """Fit on the training rows; no label is read. One row per column and element reaches the driver."""
    rows = scaler_table(train, columns, floor, vector, dims, prefix="").collect()
    found = {r["feature"]: r for r in rows}
    inside = [str(i) for i in range(dims if vector else 0)]
    if any(c not in found or not found[c]["n_train"] or not found[c]["n"] for c in [*columns, *inside]):
        raise ValueError("the training period has no usable value for some context column")

    def get(names, part) -> tuple[float, ...]:
        return tuple(found[c][part] for c in names)

    return Scaler(found[columns[0]]["n_train"], tuple(columns), get(columns, "mean"), get(columns, "std"),
                  vector, get(inside, "mean"), get(inside, "std"))


def scale_context(df: DataFrame, scaler: Scaler, keep: list[str]) -> DataFrame:
    """Standardised contexts ``x`` with an intercept; a missing value sits at the mean.

    Contexts are wider than the vectors they come from: rows that have to be arranged are better arranged before.
    """
    values = [
        F.coalesce((S.scaled_feature(c) - F.lit(mean)) / F.lit(std), F.lit(0.0))
        for c, mean, std in zip(scaler.columns, scaler.mean, scaler.std)
    ]
    rows = df.select(*keep, F.array(F.lit(1.0), *values).alias("x"), *([F.col(scaler.vector).alias("_vector")] if scaler.vector else []))
    if not scaler.vector:
        return rows
    mean, std = np.array(scaler.vector_mean), np.array(scaler.vector_std)
    width = 1 + len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            v = known_matrix(part.column("_vector"), len(mean))
            x = np.hstack([matrix(part.column("x"), width), np.where(np.isnan(v), 0.0, (v - mean) / std)])
            yield with_column(part.select(keep), "x", lists(x))

    return rows.mapInArrow(run, extended(df.select(*keep).schema, "x array<double>"))


# --- policies and model state -----------------------------------------------
@dataclass(frozen=True)
class Policy:
    name: str = "default"
    alpha: float = 1.0
    reward: float = C.TRUE_POSITIVE_REWARD
    cost: float = C.REVIEW_COST
    #: Share of a day's rows that it reviews; None takes the replay's.
    budget: float | None = None

    def slots(self, n_rows: int, budget: float) -> int:
        return max(1, math.ceil(n_rows * float(budget if self.budget is None else self.budget)))


def by_policy(policies: list[Policy], value) -> Column:
    """A number per policy as an expression on the column ``policy``."""
    cases = " ".join(f"when policy = '{p.name}' then {value(p)!r}" for p in policies)
    return F.expr(f"case {cases} end")


def policy_grid(cost: float = C.REVIEW_COST) -> list[Policy]:
    return [Policy(name, alpha, reward, cost) for name, alpha, reward in C.POLICY_GRID]


def policy_table(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    rows = [(p.name, float(p.alpha), float(p.reward), float(p.cost)) for p in policies]
    return spark.createDataFrame(rows, "policy string, alpha double, true_positive_reward double, review_cost double")


@dataclass
class Model:
    """Model of one policy: the design matrix A and the reward vector b."""

    a: np.ndarray
    b: np.ndarray

    @classmethod
    def fresh(cls, dims: int, ridge: float) -> Model:
        return cls(np.eye(dims) * ridge, np.zeros(dims))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """The coefficient vector and a factor F with xT A^-1 x = |F x|^2."""
        factor = np.linalg.inv(np.linalg.cholesky(self.a))
        return np.linalg.solve(self.a, self.b), factor


@dataclass
class State:
    """Models of all policies before some day."""

    models: dict[str, Model]
    last_day: dt.date | None = None
    days: list[dt.date] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, self.last_day, m.a.ravel().tolist(), m.b.tolist())
            for name, m in sorted(self.models.items())
        ]
        return spark.createDataFrame(rows, STATE_SCHEMA)

    @classmethod
    def from_table(cls, df: DataFrame) -> State:
        """One row per policy."""
        models, last = {}, None
        for row in df.collect():
            b = np.array(row["b"])
            models[row["policy"]] = Model(np.array(row["a"]).reshape(len(b), len(b)), b)
            last = row["day"]
        return cls(models, last)


STATE_SCHEMA = "policy string, day date, a array<double>, b array<double>"


# --- one day ----------------------------------------------------------------
def bandit_scores(
    contexts: DataFrame, policies: list[Policy], state: State, keep: list[str], with_x: bool = True,
    bounds: dict[str, float] | None = None,
) -> DataFrame:
    """One row per event and policy with its upper confidence bound ``ucb_score``.

    All policies share one scan; the models travel in the task closure. Without
    ``with_x`` the contexts stay behind. Of a policy in ``bounds`` only rows from its bound on come out.
    """
    bounds = bounds or {}
    settings = [(p.name, p.alpha, *state.models[p.name].weights()) for p in policies]
    rows = contexts.select(*keep, "x")
    schema = extended(rows.schema if with_x else contexts.select(*keep).schema, "policy string, ucb_score double")
    dims = len(settings[0][2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = matrix(part.column("x"), dims)
            part = part if with_x else part.drop_columns(["x"])
            for name, alpha, theta, factor in settings:
                score = x @ theta + alpha * np.linalg.norm(x @ factor.T, axis=1)
                rows = part
                if name in bounds:
                    above = score >= bounds[name]
                    rows, score = part.filter(pa.array(above)), score[above]
                named = with_column(rows, "policy", pa.array([name] * len(score), pa.string()))
                yield with_column(named, "ucb_score", pa.array(score))

    return rows.mapInArrow(run, schema)


def day_candidates(
    contexts: DataFrame, policies: list[Policy], state: State, n_rows: int, budget: float
) -> tuple[DataFrame, int] | None:
    """The scored rows of a day that a policy may review, with their contexts, and the most of them that a policy has.

    Two scans and no shuffle of contexts: a quantile sketch of the scores, merged in every task, bounds the score of a
    policy's last reviewed row, and the second scan writes only rows within the bound. That is the quota, two
    ten-thousandths of the day, and ties. None if some policy should have too few of them.
    """
    score = F.round("ucb_score", SCORE_PLACES)
    scored = bandit_scores(contexts, policies, state, [], with_x=False).withColumn("_score", score)
    number = sort_numbers(scored, Key("_score", descending=True))[0]
    shares = [min(1.0, p.slots(n_rows, budget) / n_rows + 2 / ACCURACY) for p in policies]
    sketch = scored.groupBy("policy").agg(F.percentile_approx(number, shares, ACCURACY).alias("edges"))
    place = {p.name: i for i, p in enumerate(policies)}
    edges = {r["policy"]: -r["edges"][place[r["policy"]]] for r in sketch.collect()}  # one row per policy
    edges = {name: edge for name, edge in edges.items() if math.isfinite(edge)}
    # a little room for what rounding moves; the rounded scores decide
    near = bandit_scores(contexts, policies, state, QUEUE_KEEP, bounds={n: e - 1e-8 * max(1.0, abs(e)) for n, e in edges.items()})
    edge = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("policy") == n, F.lit(e)) for n, e in edges.items()])
    near = materialize(near.filter(edge.isNull() | (score >= edge)), "day-candidates")
    found = {r["policy"]: r["count"] for r in near.groupBy("policy").count().collect()}  # one row per policy
    if any(found.get(p.name, 0) < min(p.slots(n_rows, budget), n_rows) for p in policies):
        return None
    return near, max(found.values())


def review_day(
    scored: DataFrame, policies: list[Policy], n_rows: int, budget: float, tie: str = "seq",
    rows_per_task: int = VECTOR_ROWS_PER_TASK, narrowed: int | None = None,
) -> DataFrame:
    """The best rows of a day for every policy, by its own budget.

    A day of more than ``rows_per_task`` rows should be a written table: the selection reads it several times.
    ``narrowed`` is the size of the largest policy's rows where ``scored`` holds candidates only.
    """
    rows = scored.withColumn("_score", F.round("ucb_score", SCORE_PLACES))
    slots = by_policy(policies, lambda p: p.slots(n_rows, budget))
    if (n_rows if narrowed is None else narrowed) <= rows_per_task:
        # as in larger groups, a score that is no number comes last
        best = Window.partitionBy("policy").orderBy(Key("_score", descending=True).order(rows), tie)
        return rows.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= slots).drop("_rank", "_score")
    quotas = rows.select("policy").distinct().withColumn("quota", slots.cast("bigint"))
    keys = [Key("_score", descending=True), Key(tie)]
    return take_in_order(rows, ["policy"], keys, quotas, rows_per_task, largest=narrowed, narrow=narrowed is None).drop("_score")


def feedback(queue: DataFrame, policies: list[Policy]) -> DataFrame:
    """The reward that the review of each queued row returned."""
    gain, cost = by_policy(policies, lambda p: float(p.reward)), by_policy(policies, lambda p: float(p.cost))
    return queue.withColumn("review_reward", F.when(F.col("is_malicious") == 1, gain).otherwise(-cost).cast("double"))


def update_sums(queue: DataFrame, dims: int, by: tuple[str, ...] = ("policy",)) -> DataFrame:
    """Sums of x xT and of reward times x over reviewed rows.

    One output row per key and matrix row ``i``. Every task adds up its own rows
    first, so the shuffle carries d rows per task and key, whatever the queue's size.
    """
    schema = extended(queue.select(*by).schema, "i int, v array<double>")
    key_types = [to_arrow_type(queue.schema[c].dataType) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for rows in batches:
            x, r = matrix(rows.column("x"), dims), rows.column("review_reward").to_numpy(zero_copy_only=False)
            y = np.hstack([x, r[:, None]])
            for key, index in pd.DataFrame({c: rows.column(c).to_pandas() for c in by}).groupby(list(by)).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                total = x[index].T @ y[index]
                sums[key] = sums[key] + total if key in sums else total
        for key, total in sums.items():
            columns = [pa.array([v] * dims, t) for v, t in zip(key, key_types)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.arange(dims, dtype=np.int32)), lists(total)], names=[*by, "i", "v"]
            )

    partial = queue.select(*by, "x", "review_reward").mapInArrow(run, schema)
    return partial.groupBy(*by, "i").agg(vector_sum("v", dims + 1))


def apply_update(state: State, sums: DataFrame, day: dt.date) -> State:
    """Add a day's sums to the models: d rows per policy reach the driver."""
    models = {name: Model(m.a.copy(), m.b.copy()) for name, m in state.models.items()}
    for row in sums.collect():
        model, v = models[row["policy"]], np.array(row["v"])
        model.a[row["i"]] += v[:-1]
        model.b[row["i"]] += v[-1]
    return State(models, day, [*state.days, day])


# --- replay -----------------------------------------------------------------
@dataclass(frozen=True)
class Replay:
    """``queue`` holds the reviewed rows, ``daily`` one row per policy and day, ``scores`` all rows if asked for."""

    queue: DataFrame
    daily: DataFrame
    state: State
    scores: DataFrame | None = None


QUEUE_KEEP = ["id", "seq", "user", "is_malicious"]


def context_dims(contexts: DataFrame) -> int:
    row = contexts.select(F.size("x")).first()
    if row is None:
        raise ValueError("no context rows to replay")
    return row[0]


def bandit_replay(
    contexts: DataFrame,
    policies: list[Policy] | None = None,
    budget: float = 0.01,
    ridge: float = 1.0,
    tie: str = "seq",
    state: State | None = None,
    path: str | None = None,
    rows_per_task: int = VECTOR_ROWS_PER_TASK,
    keep_scores: bool = False,
) -> Replay:
    """Replay the days of ``contexts`` in order.

    ``contexts`` has ``id, seq, user, is_malicious, day, x`` and should be a table
    partitioned by ``day``: every step reads one partition. The reviewed rows of a day
    are written to ``path`` before the next day starts, so the plan never grows, and a
    replay that is started again over the same days writes the same rows. With
    ``keep_scores`` every row's score is written too, by the model its day began with. A policy
    may have a budget of its own, so that one replay serves several capacities.
    """
    policies = policies or [Policy()]
    check_budgets([budget, *[p.budget for p in policies if p.budget is not None]])
    spark = contexts.sparkSession
    volume = (
        contexts.groupBy("day").agg(F.count(F.lit(1)).alias("emails"))
        .orderBy("day").collect()  # one row per calendar day
    )
    dims = context_dims(contexts)
    state = state or State({p.name: Model.fresh(dims, ridge) for p in policies})
    path = path or fresh_path(spark, "review-queue")
    schema = None
    kept = fresh_path(spark, "scores") if keep_scores else None
    for day, n_rows in volume:
        queue = replay_day(contexts, day, n_rows, budget, policies, state, path, tie, rows_per_task, kept)
        schema = schema or queue.schema
        state = apply_update(state, update_sums(queue, dims), day)
    if schema is None:
        raise ValueError("no context rows to replay")
    # Only the days of this replay: the folder may hold others.
    days = [r[0] for r in volume]
    queue = spark.read.schema(extended(schema, "day date")).parquet(path).filter(F.col("day").between(days[0], days[-1]))
    scores = spark.read.parquet(kept) if kept else None
    return Replay(queue, replay_daily(queue, contexts, policies), state, scores)


def replay_day(
    contexts: DataFrame, day: dt.date, n_rows: int, budget: float, policies: list[Policy], state: State, path: str,
    tie: str = "seq", rows_per_task: int = VECTOR_ROWS_PER_TASK, scores: str | None = None,
) -> DataFrame:
    """Score one day with ``state`` and write its reviewed rows.

    Contexts travel with the scores on a small day, and with the candidates of a large one. Where ``scores`` names a
    folder to keep them in, or candidates are too few, the scores are written without, and the reviewed rows
    fetch theirs by ``tie``, a row's place in the log.
    """
    spark = contexts.sparkSession
    rows = contexts.filter(F.col("day") == F.lit(day))
    large = n_rows > min(rows_per_task, SMALL_DAY)
    near = day_candidates(rows, policies, state, n_rows, budget) if large and scores is None else None
    narrow = scores is not None or (large and near is None)
    if near is None:
        scored, most = bandit_scores(rows, policies, state, QUEUE_KEEP, with_x=not narrow), None
    else:
        scored, most = near
    if narrow:
        kept = f"{scores or fresh_path(spark, 'day-scores')}/day={day.isoformat()}"
        scored.write.mode("overwrite").parquet(kept)
        scored = spark.read.schema(scored.schema).parquet(kept)
    chosen = feedback(review_day(scored, policies, n_rows, budget, tie, rows_per_task, most), policies)
    if narrow:
        chosen = chosen.join(rows.select(tie, "x"), tie).select(*QUEUE_KEEP, "x", "policy", "ucb_score", "review_reward")
    target = f"{path}/day={day.isoformat()}"
    chosen.write.mode("overwrite").parquet(target)
    return spark.read.schema(chosen.schema).parquet(target)


def replay_daily(queue: DataFrame, contexts: DataFrame, policies: list[Policy]) -> DataFrame:
    """Daily metrics of every policy, with its own reward and cost."""
    volume = contexts.groupBy("day").agg(
        F.count(F.lit(1)).alias("emails"),
        F.sum("is_malicious").cast("bigint").alias("available_malicious"),
    )
    reviewed = queue.groupBy("policy", "day").agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.sum("is_malicious").cast("bigint").alias("true_positives"),
    )
    table = policy_table(queue.sparkSession, policies)
    joined = reviewed.join(volume, "day").join(F.broadcast(table), "policy")  # one row per policy
    daily = add_rewards(joined, F.col("true_positive_reward"), F.col("review_cost"))
    return daily.select(
        "policy", "day", "emails", "reviewed", "true_positives", "false_positives",
        "available_malicious", "oracle_true_positives", "reward", "oracle_reward",
    )


def with_budgets(rows: DataFrame, policies: list[Policy], budget: float = 0.01) -> DataFrame:
    """``rows`` with the ``budget`` of their policy."""
    return rows.withColumn("budget", by_policy(policies, lambda p: float(budget if p.budget is None else p.budget)).cast("double"))


def sensitivity_table(
    replay: Replay, policies: list[Policy], summary: DataFrame, hits: DataFrame, labels: DataFrame
) -> DataFrame:
    """One row per policy and scenario of the labels or hits: settings, run summary and hits in the scenario.

    Without any scenario a policy keeps one row.
    """
    table = policy_table(replay.queue.sparkSession, policies).join(summary, "policy")
    scenarios = labels.select(F.col("scenario").cast("int").alias("scenario")).unionByName(hits.select("scenario")).distinct()
    found = hits.select("policy", "scenario", F.col("true_positives").alias("scenario_true_positives"))
    # a few scenarios
    rows = table.join(F.broadcast(scenarios), F.lit(True), "left").join(found, ["policy", "scenario"], "left")
    return rows.na.fill(0, ["scenario_true_positives"])
