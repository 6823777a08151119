import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators.bandit import Policy, bandit_replay
from riskloom.operators.semantic import semantic_deviation
from riskloom.plans import stream_queries
from riskloom.streaming.aggregates import daily_stream
from riskloom.streaming.deviation import deviation_stream
from riskloom.streaming.logs import read_log_stream, run_to_end
from riskloom.streaming.replay import replay_stream
from tests.test_models import CONTEXT_SCHEMA, SCHEMA, contexts, events, same


def files(spark, df, column, path):
    """One file per value, in order of arrival."""
    for value in [r[0] for r in df.select(column).distinct().orderBy(column).collect()]:
        df.filter(F.col(column) == F.lit(value)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_day_closes_with_the_next(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, h), d) for d in (1, 2, 3) for h in range(d + 1)]
    df = spark.createDataFrame(rows, "ts timestamp, d int")
    path = files(spark, df, "d", str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = read_log_stream(spark, path, df.schema, files_per_batch=1)
    run_to_end(daily_stream(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"))
    closed = {r["day"].day: r["emails"] for r in spark.read.parquet(out).collect()}
    assert closed == {1: 2, 2: 3}


@pytest.mark.parametrize("rows_per_task", [6, 10**6])
def test_deviation_over_batches(spark, tmp_path, rows_per_task):
    df = spark.createDataFrame(events(n=90), SCHEMA).withColumn("part", F.floor(F.col("seq") / 30))
    path = files(spark, df, "part", str(tmp_path / "in"))
    stream = read_log_stream(spark, path, df.schema, files_per_batch=1)
    got = deviation_stream(stream, 5, keep=("seq",), rows_per_task=rows_per_task)
    want = semantic_deviation(df)
    same(
        {r["seq"]: r["semantic_deviation"] for r in got.collect()},
        {r["seq"]: r["semantic_deviation"] for r in want.collect()},
    )


def test_replay_over_batches_and_restart(spark, tmp_path):
    rows = contexts(days=4)
    df = spark.createDataFrame(rows, CONTEXT_SCHEMA).withColumn("part", F.floor(F.col("seq") / 50))
    source, work, marks = (str(tmp_path / n) for n in ("in", "work", "marks"))
    policies = [Policy("p", 0.5), Policy("q", 2.0)]

    def go(flush):
        stream = read_log_stream(spark, source, df.schema, files_per_batch=1)
        return replay_stream(stream, 4, policies, 0.1, path=work, checkpoint=marks, flush=flush)

    files(spark, df.filter("part < 3"), "part", source)
    first = go(flush=False)
    assert first.daily.select("day").distinct().count() == 2  # the last day is open
    files(spark, df.filter("part >= 3"), "part", source)
    got = go(flush=True)
    want = bandit_replay(df.drop("part"), policies, 0.1)
    order = ["policy", "day"]
    assert got.daily.orderBy(*order).collect() == want.daily.orderBy(*order).collect()
    assert {(r["policy"], r["id"]) for r in got.queue.collect()} == {(r["policy"], r["id"]) for r in want.queue.collect()}
    # A row of a closed day is late and changes nothing.
    df.filter("seq = 0").write.mode("append").parquet(source)
    again = go(flush=True)
    assert again.daily.orderBy(*order).collect() == want.daily.orderBy(*order).collect()


def test_deviation_does_not_depend_on_arrival(spark, tmp_path, monkeypatch):
    from riskloom.streaming import deviation

    monkeypatch.setattr(deviation, "COMPACT", 2)
    rows = spark.createDataFrame(events(n=80), SCHEMA).filter("ts is not null").collect()
    rows = sorted(rows, key=lambda r: (r["ts"], r["seq"]))[:-1]  # without the lone row far behind the others
    early, late = rows[0], dt.timedelta(seconds=rows[-1]["ts"] - rows[0]["ts"])
    # every seventh row comes a file later, the first row and one without a time with the last file
    lost = early.asDict() | {"seq": 999, "ts": None}
    shifted = [(r, i // 20 + (i % 7 == 3)) for i, r in enumerate(rows[1:])] + [(early, 9)]
    df = spark.createDataFrame([(*r, p) for r, p in shifted] + [(*lost.values(), 9)], SCHEMA + ", part int")
    path = files(spark, df, "part", str(tmp_path / "in"))
    stream = read_log_stream(spark, path, df.schema, files_per_batch=1)

    def scores(**settings):
        return {r["seq"]: r["semantic_deviation"] for r in deviation_stream(stream, 5, keep=("seq",), **settings).collect()}

    punctual = {r["seq"]: r["semantic_deviation"] for r in semantic_deviation(spark.createDataFrame(rows[1:], SCHEMA)).collect()}
    whole = {r["seq"]: r["semantic_deviation"] for r in semantic_deviation(spark.createDataFrame(rows, SCHEMA)).collect()}
    state = str(tmp_path / "state")
    same(scores(delay=late / 2, state=state), punctual)
    clock = spark.read.parquet(f"{state}/clock/{deviation.FLUSHED}").first()
    assert clock["late"] == 2 and len(clock["bases"]) <= 3
    same(scores(delay=2 * late), whole)
    open_rows = scores(delay=2 * late, flush=False)
    assert open_rows == {}


def test_a_period_of_many_files_is_one_batch(spark, sf, tmp_path, monkeypatch):
    """Many tasks write a period, and the rows are those of one file for each, also where tasks have no rows."""
    def batches(table):
        path, found = str(tmp_path / "arrivals"), []
        monkeypatch.setattr(stream_queries, "fresh_path", lambda *_: path)
        monkeypatch.setattr(stream_queries.fx, "table", lambda *_: table)
        stream = stream_queries._arrivals(spark, sf)
        run_to_end(stream, lambda b, i: found.append(sorted(r["id"] for r in b.select("id").collect())))
        files = len(list((tmp_path / "arrivals").glob("*.parquet")))
        (tmp_path / "arrivals").rename(tmp_path / f"arrivals-{files}-{len(list(tmp_path.iterdir()))}")
        return found, files

    events = spark.read.parquet(f"{sf}/events.parquet")
    few = events.filter("event_id < 12")
    (whole, files), (sparse, single) = batches(events), batches(few)
    assert (files, single, len(whole)) == (4, 4, 4)
    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 100, raising=False)
    assert batches(events) == (whole, 16)
    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 1)
    assert batches(few) == (sparse, 16)
