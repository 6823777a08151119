"""Semantic deviation over a stream, in the order of event time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.schemas import extended
from riskloom.operators.semantic import VECTOR_ROWS_PER_TASK, semantic_deviation, vector_totals
from riskloom.session import fresh_path
from riskloom.sources.paths import names
from riskloom.streaming.logs import run_to_end

FLUSHED = "flushed"
#: Batches whose sums are kept apart before they are added up into one table.
COMPACT = 16
CLOCK = "seen timestamp, closed timestamp, late bigint, base string, bases array<string>"


def add_up(sums: DataFrame, user: str, dims: int) -> DataFrame:
    """One row per user out of several partial sums: rows, vector, and the time of the last row."""
    parts = [F.sum(F.get("_total", F.lit(i))) for i in range(dims)]
    return sums.groupBy(user).agg(F.sum("_rows").alias("_rows"), F.array(*parts).alias("_total"), F.max("_last").alias("_last"))


def deviation_stream(
    stream: DataFrame,
    dims: int,
    user: str = "user",
    order: tuple[str, ...] = ("ts", "seq"),
    embedding: str = "embedding",
    keep: tuple[str, ...] = ("id",),
    out: str | None = None,
    state: str | None = None,
    checkpoint: str | None = None,
    rows_per_task: int = VECTOR_ROWS_PER_TASK,
    delay: dt.timedelta = dt.timedelta(0),
    idle: dt.timedelta | None = None,
    flush: bool = True,
) -> DataFrame:
    """Score a stream as the batch operator would score the whole log, without its late rows.

    Rows wait until the stream has seen a time more than ``delay`` after theirs; then they are scored in the
    order of their times, so a file that comes out of order changes nothing. A row from before what is
    closed already, or without a time, is late and dropped. ``flush`` closes what waits at the end, apart from the
    state that a later run goes on from. A user without rows for longer than ``idle`` is forgotten.

    The history is a set of sums per user and batch. A batch writes the sums of its own users only and reads those of
    the users it closes rows of; every ``COMPACT`` batches they are added up. All is written under the batch id, so a
    repeated batch reads what it read before. A busy user is split like in the batch form, which keyed
    state could not do: it would put all of the user's rows into one task.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, "stream-deviation")
    state = state or fresh_path(spark, "stream-history")
    time = order[0]
    columns = list(dict.fromkeys([user, *order, embedding, *keep]))
    fields, kept = stream.select(*columns).schema, stream.select(user, *keep).schema
    sums = extended(stream.select(user).schema, "_rows bigint, _total array<double>, _last timestamp")

    def clock(session: SparkSession, name: str):
        return session.read.schema(CLOCK).parquet(f"{state}/clock/{name}").first()

    def advance(session: SparkSession, batch: DataFrame, before: str | None, name: str, last: bool) -> None:
        now = clock(session, before) if before is not None else None
        bases = list(now["bases"]) if now else []
        moment = F.col(time).cast("timestamp")
        punctual = moment.isNotNull() if not now or now["closed"] is None else moment >= F.lit(now["closed"])
        rows = batch.select(*columns)
        counts = rows.agg(F.max(moment).alias("seen"), F.coalesce(F.count_if(~F.coalesce(punctual, F.lit(False))), F.lit(0)).alias("late")).first()
        rows = rows.filter(punctual)
        if now:
            rows = rows.unionByName(session.read.schema(fields).parquet(f"{state}/waiting/{before}"))
        seen = max((t for t in (counts["seen"], now and now["seen"]) if t is not None), default=None)
        closed = None if seen is None else seen - delay
        due = F.lit(True) if last else F.lit(False) if closed is None else moment < F.lit(closed)
        done = rows.filter(due)
        prior = None
        if bases:
            prior = session.read.schema(sums).parquet(*[f"{state}/sums/{b}" for b in bases])
            if idle is not None and closed is not None:
                prior = prior.join(prior.groupBy(user).agg(F.max("_last").alias("_recent")).filter(
                    F.col("_recent") >= F.lit(closed - idle)).select(user), user, "left_semi")
        mine = None if prior is None else add_up(prior.join(done.select(user).distinct(), user, "left_semi"), user, dims).drop("_last")
        scored = semantic_deviation(done, user, order, embedding, dims, mine, rows_per_task, keep=tuple(kept.names))
        scored.write.mode("overwrite").parquet(f"{out}/batch={name}")
        new = vector_totals(done, [user], embedding, dims)
        last_seen = done.groupBy(F.col(user).alias("_who")).agg(F.max(moment).alias("_last"))
        new = new.join(last_seen, F.col(user) == F.col("_who")).select(user, "_rows", "_total", "_last")
        if len(bases) >= COMPACT:
            new, bases = add_up(prior.unionByName(new), user, dims), []
        new.write.mode("overwrite").parquet(f"{state}/sums/{name}")
        rows.filter(~due).write.mode("overwrite").parquet(f"{state}/waiting/{name}")
        late = counts["late"] + (now["late"] if now else 0)
        session.createDataFrame([(seen, closed, late, name, [*bases, name])], CLOCK).write.mode("overwrite").parquet(f"{state}/clock/{name}")

    def step(batch: DataFrame, batch_id: int) -> None:
        advance(batch.sparkSession, batch.persist(), str(batch_id - 1) if batch_id else None, str(batch_id), last=False)
        batch.unpersist()

    run_to_end(stream, step, checkpoint=checkpoint)
    newest = max((int(n) for n in names(spark, f"{state}/clock") if n.isdigit()), default=-1)
    if flush and newest >= 0:
        advance(spark, spark.createDataFrame([], fields), str(newest), FLUSHED, last=True)
    found = spark.read.schema(extended(kept, "semantic_deviation double, batch string")).parquet(out)
    return (found if flush else found.filter(F.col("batch") != FLUSHED)).drop("batch")
