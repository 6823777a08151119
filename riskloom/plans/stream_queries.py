"""Streaming forms, run over the whole event table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators.profile import daily_sketches
from riskloom.plans import fixtures as fx
from riskloom.plans import policy_queries as pq
from riskloom.plans import sql
from riskloom.plans.log_queries import WEEKS_SQL, weekly_users
from riskloom.session import fresh_path
from riskloom.sources.paths import names
from riskloom.streaming.aggregates import daily_stream, profile_stream
from riskloom.streaming.deviation import deviation_stream
from riskloom.streaming.logs import closed_rows, latest_table, read_log_stream
from riskloom.streaming.replay import replay_stream


#: Periods of a stream; each holds some days, and rows that come later than their day.
PERIODS, PERIOD_DAYS, DELAY_DAYS = 3, 10, 3
#: Rows of a file, about. All periods come in the same number of files, so that a period is a batch.
ROWS_PER_FILE = 500_000


def _events(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = fx.table(spark, sf, "events").schema
    return fx.from_events(read_log_stream(spark, sf, schema, "events.parquet"))


def _arrivals(spark, sf):
    """The events as a stream of periods in the order of their days, each written by many tasks. One row in twenty comes a
    period late, another one in twenty comes with the last period."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = fx.table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    period = F.least(F.floor(day / PERIOD_DAYS), F.lit(PERIODS - 1))
    arrival = F.when(fx.prop() % 20 == 7, PERIODS).when(fx.prop() % 20 == 9, period + 1).otherwise(period)
    path = fresh_path(spark, "arrivals")
    files = max(1, -(-events.count() // (PERIODS * ROWS_PER_FILE)))
    for i in range(PERIODS + 1):
        events.filter(arrival == i).repartition(files).write.mode("append").parquet(path)
        # a task without rows writes no file; empty ones take the places
        while sum(n.endswith(".parquet") for n in names(spark, path)) < files * (i + 1):
            events.limit(0).write.mode("append").parquet(path)
    return fx.from_events(read_log_stream(spark, path, events.schema, files_per_batch=files))


def stream_profile(spark, sf):
    profile = latest_table(profile_stream(_events(spark, sf), fx.DOMAIN), "stream-profile")
    return fx.rounded(profile.drop("approx_users"), "mean", "std", "min", "max")


def stream_daily_counts(spark, sf):
    return fx.day_text(latest_table(daily_stream(_events(spark, sf)), "stream-daily"))


def stream_weekly_users(spark, sf):
    """Weekly distinct users out of daily sketches that a stream of several files keeps."""
    sketches = latest_table(daily_sketches(_arrivals(spark, sf)), "stream-sketches")
    return weekly_users(spark, sf, sketches)


def stream_closed_days(spark, sf):
    """Rows per day in append mode, over many files: a day appears once it is closed, later rows of it are dropped, and days
    that are still open at the end do not appear."""
    counts = daily_stream(_arrivals(spark, sf), late=f"{DELAY_DAYS} days")
    return fx.day_text(closed_rows(counts, "stream-closed"))


def stream_deviation(spark, sf):
    """The deviation in event time, over files of which rows come late."""
    log = fx.with_vectors(_arrivals(spark, sf), fx.table(spark, sf, "embeddings"))
    scored = deviation_stream(log, sql.DIMS, delay=dt.timedelta(days=DELAY_DAYS))
    return fx.rounded(scored.select("id", "semantic_deviation"), "semantic_deviation")


ARRIVALS = f"""came AS (SELECT *, CASE WHEN k % 20 = 7 THEN {PERIODS} WHEN k % 20 = 9 THEN period + 1 ELSE period END AS arrival
FROM (SELECT *, least((day - DATE '2024-01-01') // {PERIOD_DAYS}, {PERIODS - 1}) AS period FROM act)),
marks AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  - INTERVAL {DELAY_DAYS} DAY AS mark FROM came GROUP BY arrival),
timed AS (SELECT c.*, m.mark FROM came c JOIN marks m ON m.arrival = c.arrival)"""
#: The log without the rows that are late.
PUNCTUAL = sql.ACT.replace("act AS (", "every AS (", 1) + ", " + ARRIVALS.replace("FROM act", "FROM every") + \
    ", act AS (SELECT * EXCLUDE (period, arrival, mark) FROM timed WHERE mark IS NULL OR ts >= mark)"
#: Spark drops rows by the watermark that the batch before began with, one file further back.
CLOSED_SQL = f"""WITH {sql.ACT}, {ARRIVALS.replace('1 PRECEDING', '2 PRECEDING')}
SELECT CAST(day AS VARCHAR) AS day, count(*) AS emails FROM timed WHERE mark IS NULL OR day + INTERVAL 1 DAY > mark
GROUP BY day HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) FROM act) - INTERVAL {DELAY_DAYS} DAY"""


def stream_bandit_daily(spark, sf):
    """The replay over written contexts, arriving as a stream."""
    rows = pq._written_contexts(spark, sf)
    path = rows.inputFiles()[0].rsplit("/day=", 1)[0]
    stream = read_log_stream(spark, path, rows.schema)
    return fx.day_text(replay_stream(stream, pq.N, budget=pq.REPLAY_BUDGET).daily)


QUERIES = {
    "stream_profile": (stream_profile, f"""WITH {sql.ACT}, {sql.META}
        SELECT activity, count(*) AS n_rows, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS std,
          round(min(size), 6) AS min, round(max(size), 6) AS max,
          count(*) FILTER (attachment_count > 0) AS n_with_attachment,
          count(*) FILTER (n_recipients_external > 0) AS n_with_external FROM meta GROUP BY activity"""),
    "stream_daily_counts": (stream_daily_counts, f"""WITH {sql.ACT}
        SELECT CAST(day AS VARCHAR) AS day, count(*) AS emails FROM act GROUP BY day"""),
    "stream_weekly_users": (stream_weekly_users, WEEKS_SQL),
    "stream_closed_days": (stream_closed_days, CLOSED_SQL),
    "stream_deviation": (stream_deviation, f"""WITH {PUNCTUAL}, {sql.VECTORS}, {sql.DEVIATION}
        SELECT id, round(semantic_deviation, 6) AS semantic_deviation FROM dev"""),
    "stream_bandit_daily": (stream_bandit_daily, pq.DAILY_SQL),
}
