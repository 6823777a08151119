"""The bandit over a stream of contexts, its model carried from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.schemas import extended
from riskloom.operators.bandit import (
    STATE_SCHEMA, Model, Policy, Replay, State, apply_update, replay_daily, replay_day, update_sums,
)
from riskloom.operators.semantic import VECTOR_ROWS_PER_TASK
from riskloom.session import fresh_path
from riskloom.sources.paths import names
from riskloom.streaming.logs import run_to_end

FLUSHED = "flushed"
COLUMNS = ["id", "seq", "user", "is_malicious", "day", "x"]


def replay_stream(
    stream: DataFrame,
    dims: int,
    policies: list[Policy] | None = None,
    budget: float = 0.01,
    ridge: float = 1.0,
    path: str | None = None,
    checkpoint: str | None = None,
    flush: bool = True,
    rows_per_task: int = VECTOR_ROWS_PER_TASK,
) -> Replay:
    """Replay days as they close.

    A day closes when a row of a later day arrives. Rows of the open day wait in a
    table; rows of a day already closed are late and dropped. Models, the waiting rows
    and the closed days' rows are written under the batch id, so a repeated batch
    starts from what it started from before. ``flush`` closes the last day at the end.
    """
    spark = stream.sparkSession
    policies = policies or [Policy()]
    path = path or fresh_path(spark, "stream-replay")
    fresh = State({p.name: Model.fresh(dims, ridge) for p in policies})
    fields = stream.select(*COLUMNS).schema

    def load(session, batch_id: int | str) -> tuple[State, DataFrame | None]:
        if batch_id == -1:
            return fresh, None
        models = session.read.schema(STATE_SCHEMA).parquet(f"{path}/state/{batch_id}")
        return State.from_table(models), session.read.schema(fields).parquet(f"{path}/waiting/{batch_id}")

    def close(rows: DataFrame, state: State, days: list) -> State:
        for day, n_rows in days:
            queue = replay_day(rows, day, n_rows, budget, policies, state, f"{path}/queue", rows_per_task=rows_per_task)
            state = apply_update(state, update_sums(queue, dims), day)
        return state

    def advance(session, batch: DataFrame, before: int, name: str, last: bool) -> None:
        state, waiting = load(session, before)
        rows = batch.select(*COLUMNS)
        if state.last_day is not None:
            rows = rows.filter(F.col("day") > F.lit(state.last_day))
        rows = rows if waiting is None else rows.unionByName(waiting)
        rows = rows.persist()
        days = rows.groupBy("day").count().orderBy("day").collect()  # one row per calendar day
        closed = days if last else days[:-1]
        done = F.col("day") <= F.lit(closed[-1][0]) if closed else F.lit(False)
        rows.filter(done).write.mode("overwrite").parquet(f"{path}/closed/batch={name}")
        state = close(rows, state, closed)
        rows.filter(~done).write.mode("overwrite").parquet(f"{path}/waiting/{name}")
        state.table(session).write.mode("overwrite").parquet(f"{path}/state/{name}")
        rows.unpersist()

    def step(batch: DataFrame, batch_id: int) -> None:
        advance(batch.sparkSession, batch, batch_id - 1, str(batch_id), last=False)

    run_to_end(stream, step, checkpoint=checkpoint)
    newest = max((int(n) for n in names(spark, f"{path}/state") if n.isdigit()), default=-1)
    if newest < 0:
        raise ValueError("the stream has brought no batch yet")
    if flush:
        # Kept apart from the batches, so a later run goes on from the last real one.
        advance(spark, spark.createDataFrame([], fields), newest, FLUSHED, last=True)
    closed = spark.read.schema(extended(fields, "batch string")).parquet(f"{path}/closed")
    closed = closed if flush else closed.filter(F.col("batch") != FLUSHED)
    state, _ = load(spark, FLUSHED if flush else newest)
    if state.last_day is None:
        raise ValueError("no day has closed yet")
    queue = spark.read.parquet(f"{path}/queue").filter(F.col("day") <= F.lit(state.last_day))
    return Replay(queue, replay_daily(queue, closed, policies), state)
