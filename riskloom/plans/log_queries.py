"""Sources, profile, scalar functions and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import scalars as S
from riskloom.operators import features as feat
from riskloom.operators import labels as lab
from riskloom.operators import profile as prof
from riskloom.operators.capacity import day_sequence
from riskloom.operators.embed import LetterCounts, embed_text
from riskloom.plans import fixtures as fx
from riskloom.plans import sql
from riskloom.session import fresh_path, materialize
from riskloom.sources import incidents as inc
from riskloom.sources.archive import write_zipped_csv
from riskloom.sources.logs import bounded_prefix, read_daily, read_labels, read_log, read_split_log, read_zipped_log
from riskloom.sources.sinks import publish, publish_version, read_version
from riskloom.sources.snapshots import read_snapshots, snapshot_summary

LOG = ["doc_id", "text"]
#: Bytes of text in an archive, and the least number of archives.
ARCHIVE_BYTES, LEAST_ARCHIVES = 64 << 20, 4


def _log_file(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "log")
    fx.table(spark, sf, "documents").select(*LOG).write.options(header="true", quote='"', escape='"').csv(path)
    return path


def _log_digest(log: DataFrame) -> DataFrame:
    return log.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"),
    )


def scan_log(spark, sf):
    return _log_digest(read_log(spark, _log_file(spark, sf), columns=LOG))


def scan_split_log(spark, sf):
    return _log_digest(read_split_log(spark, _log_file(spark, sf), columns=LOG))


def scan_zip(spark, sf):
    """The log out of several zip archives, each written by one task and read by member. Their number grows with the text."""
    log = fx.table(spark, sf, "documents").select(*LOG)
    size = log.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    log = log.repartition(max(LEAST_ARCHIVES, -(-size // ARCHIVE_BYTES)))
    written = write_zipped_csv(log, fresh_path(spark, "archives"))
    archives = [r["path"] for r in materialize(written, "archive-list").collect()]  # one per task
    return _log_digest(read_zipped_log(spark, archives, r"log\.csv", LOG))


SCAN_SQL = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM documents"

# --- directory snapshots ----------------------------------------------------
DIRECTORY = ["user_id", "name", "segment"]


def _snapshots(spark, sf):
    root = fresh_path(spark, "directory")
    people = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    # the second month has its columns in another order, and one more
    later = people.select("segment", "user_id", F.lit("x").alias("extra"), "name")
    for month, part, rows in (("2024-01", 0, people), ("2024-02", 1, later)):
        rows.filter(F.col("user_id") % 2 == part).write.options(header="true", escape='"').csv(f"{root}/{month}.csv")
    return read_snapshots(spark, f"{root}/*.csv", DIRECTORY)


def snapshot_union(spark, sf):
    return _snapshots(spark, sf)


SNAPSHOT_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, c_mktsegment AS segment,
CASE WHEN c_custkey % 2 = 0 THEN '2024-01' ELSE '2024-02' END AS snapshot_month FROM customer"""


def snapshot_counts(spark, sf):
    return snapshot_summary(_snapshots(spark, sf))


# --- stored results ---------------------------------------------------------
def _week():
    return F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 7).cast("bigint").alias("week")


def weekly_users(spark, sf, sketches=None):
    """Distinct users of every week, united from the daily sketches of a published table, against the exact count."""
    log = fx.activity(spark, sf)
    path = fresh_path(spark, "user-sketches")
    publish_version(sketches if sketches is not None else prof.daily_sketches(log), path)
    found = prof.united_users(read_version(spark, path), _week())
    exact = log.groupBy(_week()).agg(F.countDistinct("user").alias("n_users"))
    close = F.abs(F.col("approx_users") / F.col("n_users") - 1) < 0.08
    return found.join(exact, "week").select("week", "n_rows", "n_users", close.alias("close"))


WEEKS_SQL = f"""WITH {sql.ACT} SELECT CAST((day - DATE '2024-01-01') // 7 AS BIGINT) AS week, count(*) AS n_rows,
count(DISTINCT "user") AS n_users, true AS close FROM act GROUP BY 1"""


def published_series(spark, sf):
    """A table published twice: the second version is read, and the first can still be named."""
    log = fx.activity(spark, sf)
    path = fresh_path(spark, "series")
    daily = log.groupBy("day").agg(F.count(F.lit(1)).alias("emails"), F.sum("is_malicious").alias("true_positives"))
    first = publish_version(daily.filter(F.day("day") <= 15), path)
    publish_version(daily, path, partition_by=["day"])
    earlier = read_version(spark, path, first).select("day", F.col("emails").alias("emails_before"))
    rows = read_version(spark, path).select("day", "emails", "true_positives").join(earlier, "day", "left")
    return fx.day_text(rows)


def daily_series(spark, sf):
    """A daily series written as CSV with its dates as the reports have them, and read for one budget."""
    log = fx.activity(spark, sf)
    path = fresh_path(spark, "daily-series")
    daily = log.groupBy("day").agg(F.sum("is_malicious").alias("true_positives"))
    date = F.when(F.day("day") % 2 == 0, F.date_format("day", "MM/dd/yyyy")).otherwise(F.col("day").cast("string"))
    budgets = F.explode(F.array(*[F.lit(b) for b in fx.BUDGETS])).alias("budget")
    publish(daily.select(date.alias("date"), budgets, "true_positives"), path, "csv")
    return fx.day_text(read_daily(spark, path, 0.005))


# --- incidents --------------------------------------------------------------
def _incident_files(spark, sf) -> tuple[str, str]:
    """An index with one incident per user with labelled events, and a detail file for
    all but every fifth of them. Each detail file holds the user's own rows."""
    log = fx.activity(spark, sf)
    root = fresh_path(spark, "answers")
    index = log.filter("is_malicious = 1").groupBy("user").agg(
        F.min("scenario").alias("scenario"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    fmt = C.INDEX_TIME_FORMAT
    start = F.date_format("start", fmt)
    index.select(
        F.when(F.col("user") % 3 == 0, "6.1").otherwise("6.2").alias("dataset"),
        F.col("scenario").cast("string").alias("scenario"),
        F.concat(F.lit("r-"), F.col("user"), F.lit(".csv")).alias("details"),
        F.col("user").cast("string").alias("user"),
        F.when(F.col("user") % 7 == 0, F.regexp_replace(start, "^[0-9]+", "")).otherwise(start).alias("start"),
        F.date_format("end", fmt).alias("end"),
    ).write.option("header", "true").csv(f"{root}/index")
    rows = log.join(index.select("user"), "user", "left_semi").filter(
        (F.col("user") % 5 != 0) & ((F.col("activity") != fx.LABEL_TYPE) | (F.col("is_malicious") == 1))
    )
    tail = F.when(F.col("k") % 5 > 0, F.repeat(F.lit(',"x, y"'), F.col("k") % 5)).otherwise("")
    line = F.concat_ws(",", "activity", "id", F.date_format("ts", C.LOG_TIME_TEXT), "user")
    named = rows.select(
        F.concat(F.lit("r-"), F.col("user"), F.lit(".csv")).alias("details"),
        F.concat(line, tail).alias("value"), "user",
    )
    short = named.select("details", "user").distinct().select(
        "details", F.explode(F.array(F.lit("logon"), F.concat(F.lit("device,"), F.col("user")))).alias("value")
    )
    named.select("details", "value").unionByName(short).repartition("details").write.partitionBy(
        "details"
    ).text(f"{root}/details")
    return f"{root}/index", f"{root}/details/*"


INSIDERS_SQL = """insiders AS (
SELECT "user", min(scenario) AS scenario, min(ts) AS t0, max(ts) AS t1 FROM act WHERE is_malicious = 1 GROUP BY "user")"""
DETAIL_SQL = """detail AS (
SELECT 'r-' || a."user" || '.csv' AS details, a.activity AS log_type, CAST(a.id AS VARCHAR) AS id,
  strftime(a.ts, '%m/%d/%Y %H:%M:%S') AS date, CAST(a."user" AS VARCHAR) AS "user"
FROM act a JOIN insiders i ON i."user" = a."user"
WHERE a."user" % 5 <> 0 AND (a.activity <> 'error' OR a.is_malicious = 1)
UNION ALL SELECT 'r-' || "user" || '.csv', 'logon', '', '', '' FROM insiders WHERE "user" % 5 <> 0
UNION ALL SELECT 'r-' || "user" || '.csv', 'device', CAST("user" AS VARCHAR), '', '' FROM insiders WHERE "user" % 5 <> 0)"""
INCIDENT_BASE = ", ".join([sql.ACT, INSIDERS_SQL, DETAIL_SQL])


def _moment(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def incident_index(spark, sf):
    index, _ = _incident_files(spark, sf)
    return inc.read_incident_index(spark, index).select(
        "dataset", "scenario", "details", "user",
        _moment("start_ts").alias("start_time"), _moment("end_ts").alias("end_time"),
    )


INCIDENT_SQL = f"""WITH {sql.ACT}, {INSIDERS_SQL}
SELECT '6.2' AS dataset, CAST(scenario AS VARCHAR) AS scenario, 'r-' || "user" || '.csv' AS details,
  CAST("user" AS VARCHAR) AS "user",
  CASE WHEN "user" % 7 <> 0 THEN strftime(t0, '%Y-%m-%d %H:%M:%S') END AS start_time,
  strftime(t1, '%Y-%m-%d %H:%M:%S') AS end_time
FROM insiders WHERE "user" % 3 <> 0"""


def ragged_prefix_scan(spark, sf):
    _, details = _incident_files(spark, sf)
    return inc.read_detail_rows(spark, details).select("details", *inc.PREFIX_COLUMNS)


RAGGED_SQL = f'WITH {INCIDENT_BASE} SELECT details, log_type, id, date, "user" FROM detail'


def incident_row_counts(spark, sf):
    _, details = _incident_files(spark, sf)
    return inc.detail_counts(inc.read_detail_rows(spark, details), fx.LABEL_TYPE)


ROW_COUNTS_SQL = f"""WITH {INCIDENT_BASE}
SELECT details, count(*) AS n_rows, count(*) FILTER (log_type = 'error') AS n_matching FROM detail GROUP BY details"""


def missing_detail_files(spark, sf):
    index, details = _incident_files(spark, sf)
    found = inc.missing_details(inc.read_incident_index(spark, index), inc.read_detail_rows(spark, details))
    return found.select("details", "user")


MISSING_SQL = f"""WITH {sql.ACT}, {INSIDERS_SQL}
SELECT 'r-' || "user" || '.csv' AS details, CAST("user" AS VARCHAR) AS "user" FROM insiders
WHERE "user" % 3 <> 0 AND "user" % 5 = 0"""


def _labels(spark, sf):
    index, details = _incident_files(spark, sf)
    labels = inc.extract_labels(
        inc.read_incident_index(spark, index), inc.read_detail_rows(spark, details), fx.LABEL_TYPE
    )
    path = fresh_path(spark, "labels")
    publish(labels, path, "csv")
    return read_labels(spark, path)


def label_lookup(spark, sf):
    return _labels(spark, sf)


LABEL_ROWS = f"""WITH {INCIDENT_BASE}, rows AS (
SELECT d.id, i.scenario, CAST(i."user" AS VARCHAR) AS insider_user, d."user" AS email_row_user, d.date
FROM detail d JOIN insiders i ON d.details = 'r-' || i."user" || '.csv'
WHERE d.log_type = 'error' AND i."user" % 3 <> 0)"""


def label_scenarios(spark, sf):
    return inc.label_coverage(_labels(spark, sf))


# --- labels -----------------------------------------------------------------
def label_flag(spark, sf):
    log = fx.activity(spark, sf).select("id", "user")
    return lab.flag_labels(log, fx.label_rows(spark, sf))


def label_match_report(spark, sf):
    return lab.label_match(fx.activity(spark, sf), fx.label_rows(spark, sf))


def label_match_missing(spark, sf):
    return lab.missing_labels(fx.activity(spark, sf), fx.label_rows(spark, sf))


def id_intersect(spark, sf):
    return lab.common_ids(fx.label_rows(spark, sf), fx.activity(spark, sf))


def id_except(spark, sf):
    return lab.ids_only_in(fx.label_rows(spark, sf), fx.activity(spark, sf))


# --- profile and scalar functions -------------------------------------------
def log_profile(spark, sf):
    return prof.profile_log(fx.activity(spark, sf), fx.DOMAIN)


def numeric_profile(spark, sf):
    return fx.rounded(prof.numeric_profile(fx.activity(spark, sf), fx.DOMAIN), "mean", "std", "min", "max")


def activity_counts(spark, sf):
    return prof.activity_counts(fx.activity(spark, sf))


def text_style_profile(spark, sf):
    rows = fx.with_content(fx.activity(spark, sf).select("id"), fx.table(spark, sf, "documents"))
    style = prof.text_style(rows, "content")
    return style.select(
        *[c for c in style.columns if c != "example_snippets"],
        F.md5(F.array_join("example_snippets", "|")).alias("snippet_digest"),
    )


STYLE_SQL = rf"""WITH {sql.ACT}, sample AS (
SELECT md5(CAST(a.id AS VARCHAR)) AS digest, a.id, d.text
FROM act a JOIN documents d ON d.doc_id = a.id % (SELECT count(*) FROM documents)
), words AS (
SELECT digest, id, text, regexp_matches(text, '[.!?]') AS sentence,
  regexp_extract_all(lower(text), '[a-z'']+') AS w FROM sample)
SELECT count(*) AS n_texts,
  round(100.0 * avg(CASE WHEN sentence THEN 1 ELSE 0 END), 1) AS pct_with_sentence_punctuation,
  round(100.0 * avg(CASE WHEN list_has_any(w, ['the','is','and','of','to','in','a','was','were']) THEN 1 ELSE 0 END), 1)
    AS pct_containing_common_stopwords,
  round(avg(len(w)), 1) AS avg_word_count,
  (SELECT md5(string_agg(substring(text, 1, 160), '|' ORDER BY digest, id))
   FROM (SELECT * FROM sample ORDER BY digest, id LIMIT 5) t) AS snippet_digest
FROM words"""


def attachment_counts(spark, sf):
    return fx.activity(spark, sf).select("id", S.list_items(F.col("attachments")).cast("bigint").alias("attachment_count"))


def recipient_counts(spark, sf):
    measures = feat.activity_features(fx.activity(spark, sf), fx.DOMAIN, keep=("id",))
    return measures.select("id", "n_recipients_internal", "n_recipients_external")


def coerce_values(spark, sf):
    log = fx.activity(spark, sf)
    number = (
        F.when(F.col("k") % 4 == 0, "n/a").when(F.col("k") % 4 == 1, "")
        .when(F.col("k") % 4 == 2, F.concat(F.col("k"), F.lit(".5"))).otherwise("NaN")
    )
    time = F.when(F.col("k") % 7 == 0, "/21/2011 11:43:39").otherwise(F.date_format("ts", C.LOG_TIME_TEXT))
    return log.select(
        "id", S.number(number).alias("number"), _moment(S.event_time(time)).alias("event_time")
    )


def activity_features(spark, sf):
    return fx.day_text(feat.activity_features(fx.activity(spark, sf), fx.DOMAIN, keep=("id", "day", "user")))


def feature_run_counts(spark, sf):
    return feat.feature_run_counts(lab.flag_labels(
        fx.activity(spark, sf).select("id", "user"), fx.label_rows(spark, sf)
    ))


def temporal_split(spark, sf):
    return feat.split_counts(fx.activity(spark, sf), fx.TRAIN_END)


def day_numbers(spark, sf):
    return fx.day_text(day_sequence(fx.activity(spark, sf)))


def first_rows(spark, sf):
    return bounded_prefix(fx.activity(spark, sf).select("id", "user", "ts", "seq"), ["ts", "seq"], 1000).select("id", "user")


def embed_documents(spark, sf):
    vectors = embed_text(fx.table(spark, sf, "documents").select("doc_id", "text"), "text", LetterCounts)
    return vectors.select("doc_id", F.posexplode("embedding").alias("at", "value")).select(
        "doc_id", F.col("at").cast("bigint").alias("letter"), F.col("value").cast("bigint").alias("n")
    )


EMBED_SQL = """SELECT doc_id, CAST(i AS BIGINT) AS letter,
  CAST(length(text) - length(replace(replace(text, chr(97 + i), ''), chr(65 + i), '')) AS BIGINT) AS n
FROM documents, (SELECT CAST(unnest(range(0, 26)) AS INTEGER) AS i) r"""

_M = [("size_bytes", "size"), ("attachments_per_row", "attachment_count"),
      ("recipients_internal", "n_recipients_internal"), ("recipients_external", "n_recipients_external")]

QUERIES = {
    "scan_log": (scan_log, SCAN_SQL),
    "scan_split_log": (scan_split_log, SCAN_SQL),
    "weekly_users": (weekly_users, WEEKS_SQL),
    "published_series": (published_series, f"""WITH {sql.ACT} SELECT CAST(day AS VARCHAR) AS day, count(*) AS emails,
        CAST(sum(is_malicious) AS BIGINT) AS true_positives, CASE WHEN day(day) <= 15 THEN count(*) END AS emails_before
        FROM act GROUP BY day"""),
    "daily_series": (daily_series, f"""WITH {sql.ACT} SELECT CAST(day AS VARCHAR) AS day,
        CAST(sum(is_malicious) AS BIGINT) AS true_positives FROM act GROUP BY day"""),
    "scan_zip": (scan_zip, SCAN_SQL),
    "snapshot_union": (snapshot_union, SNAPSHOT_SQL),
    "snapshot_counts": (snapshot_counts, f"""SELECT count(DISTINCT snapshot_month) AS n_snapshots,
        count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM ({SNAPSHOT_SQL})"""),
    "incident_index": (incident_index, INCIDENT_SQL),
    "ragged_prefix_scan": (ragged_prefix_scan, RAGGED_SQL),
    "incident_row_counts": (incident_row_counts, ROW_COUNTS_SQL),
    "missing_detail_files": (missing_detail_files, MISSING_SQL),
    "label_lookup": (label_lookup, f"{LABEL_ROWS} SELECT * FROM rows"),
    "label_scenarios": (label_scenarios, f"""{LABEL_ROWS}
        SELECT count(*) AS n_labels, count(DISTINCT scenario) AS n_scenarios FROM rows"""),
    "bounded_prefix": (first_rows, f"""WITH {sql.ACT} SELECT id, "user" FROM act ORDER BY ts, seq LIMIT 1000"""),
    "temporal_split": (temporal_split, f"""WITH {sql.ACT}
        SELECT count(*) FILTER (ts < DATE '2024-01-16') AS n_train,
          count(*) FILTER (ts >= DATE '2024-01-16') AS n_test,
          count(*) FILTER (ts >= DATE '2024-01-16' AND is_malicious = 1) AS n_test_malicious FROM act"""),
    "label_flag": (label_flag, f"""WITH {sql.ACT}, {sql.LABELS}
        SELECT id, "user", CASE WHEN id IN (SELECT id FROM lab) THEN 1 ELSE 0 END AS is_malicious FROM act"""),
    "label_match_report": (label_match_report, f"""WITH {sql.ACT}, {sql.LABELS},
        f AS (SELECT count(*) AS n FROM (SELECT DISTINCT id FROM lab WHERE id IN (SELECT id FROM act))),
        e AS (SELECT count(DISTINCT id) AS n FROM lab)
        SELECT (SELECT count(*) FROM act) AS total_rows_scanned, e.n AS n_expected, f.n AS n_found,
          e.n - f.n AS n_missing FROM f, e"""),
    "label_match_missing": (label_match_missing, f"""WITH {sql.ACT}, {sql.LABELS}
        SELECT DISTINCT id FROM lab WHERE id NOT IN (SELECT id FROM act)"""),
    "id_intersect": (id_intersect, f"WITH {sql.ACT}, {sql.LABELS} SELECT id FROM lab INTERSECT SELECT id FROM act"),
    "id_except": (id_except, f"WITH {sql.ACT}, {sql.LABELS} SELECT id FROM lab EXCEPT SELECT id FROM act"),
    "log_profile": (log_profile, f"""WITH {sql.ACT}, {sql.META}
        SELECT count(*) AS total_rows, count(DISTINCT "user") AS distinct_users,
          round(100.0 * count(*) FILTER (attachment_count > 0) / greatest(count(*), 1), 2) AS pct_with_attachment,
          round(100.0 * count(*) FILTER (n_recipients_external > 0) / greatest(count(*), 1), 2) AS pct_with_external
        FROM meta"""),
    "numeric_profile": (numeric_profile, f"WITH {sql.ACT}, {sql.META} " + " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, count({c}) AS n, round(avg({c}), 6) AS mean,
            round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM meta"""
        for m, c in _M)),
    "activity_counts": (activity_counts, f"WITH {sql.ACT} SELECT activity, count(*) AS n_rows FROM act GROUP BY activity"),
    "text_style_profile": (text_style_profile, STYLE_SQL),
    "attachment_counts": (attachment_counts, f"WITH {sql.ACT}, {sql.META} SELECT id, CAST(attachment_count AS BIGINT) AS attachment_count FROM meta"),
    "recipient_counts": (recipient_counts, f"WITH {sql.ACT}, {sql.META} SELECT id, n_recipients_internal, n_recipients_external FROM meta"),
    "coerce_values": (coerce_values, f"""WITH {sql.ACT} SELECT id,
        CASE WHEN k % 4 = 2 THEN k + 0.5::DOUBLE END AS number,
        CASE WHEN k % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_time FROM act"""),
    "activity_features": (activity_features, f"""WITH {sql.ACT}, {sql.META} SELECT id, CAST(day AS VARCHAR) AS day,
        "user", {', '.join(feat.METADATA)} FROM meta"""),
    "feature_run_counts": (feature_run_counts, f"""WITH {sql.ACT} SELECT count(*) AS total_rows,
        count(DISTINCT "user") AS n_users_seen, CAST(sum(is_malicious) AS BIGINT) AS n_malicious_rows FROM act"""),
    "day_sequence": (day_numbers, f"""WITH {sql.ACT} SELECT CAST(day AS VARCHAR) AS day, count(*) AS emails,
        dense_rank() OVER (ORDER BY day) AS day_number FROM act GROUP BY day"""),
    "embed_text": (embed_documents, EMBED_SQL),
}
