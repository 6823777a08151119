import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators.features import activity_features, expand_components, parse_log, split_by_time, split_counts
from riskloom.operators.profile import numeric_profile, profile_log, text_style


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_lenient_parsing(spark):
    row = one(
        spark, a=S.number(F.lit("12.5")), b=S.number(F.lit("x")), c=S.number(F.lit("")),
        d=S.number(F.lit("NaN")), e=S.number(F.lit("-Infinity")),
        f=S.event_time(F.lit("02/30/2010 10:00:00")), g=S.event_time(F.lit("01/02/2010 10:00:00")),
        h=S.event_time(F.lit(None).cast("string")),
    )
    assert row["a"] == 12.5
    assert [row[c] for c in "bcdefh"] == [None] * 6
    assert row["g"] == dt.datetime(2010, 1, 2, 10)


def test_lists_and_domains(spark):
    text = F.lit("a@Corp.example;b@other.example;c@corp.example.net")
    row = one(
        spark, empty=S.list_items(F.lit("")), items=S.list_items(text),
        loose=S.internal_items(text, "corp.example"), strict=S.internal_items(text, "corp.example", True),
        capped=S.internal_items(F.lit("@corp.example@corp.example"), "corp.example"),
        dot=S.internal_items(F.lit("a@corpXexample"), "corp.example"),
    )
    assert row.asDict() == {"empty": 0, "items": 3, "loose": 2, "strict": 1, "capped": 1, "dot": 0}


def test_quota_is_binary_floating_point(spark):
    row = one(
        spark, a=S.quota(F.lit(300), F.lit(0.07)), b=S.quota(F.lit(3), F.lit(0.001)), c=S.quota(F.lit(1000), F.lit(0.005))
    )
    assert (row["a"], row["b"], row["c"]) == (22, 1, 5)


def test_time_flags(spark):
    rows = [("06:59:59", 1), ("07:00:00", 0), ("17:59:59", 0), ("18:00:00", 1)]
    for clock, flag in rows:
        ts = F.lit(f"2024-01-05 {clock}").cast("timestamp")
        assert one(spark, x=S.after_hours(ts))["x"] == flag
    missing = F.lit(None).cast("timestamp")
    row = one(spark, a=S.after_hours(missing), b=S.weekend(missing),
              fri=S.weekend(F.lit("2024-01-05").cast("timestamp")), sat=S.weekend(F.lit("2024-01-06").cast("timestamp")),
              sun=S.weekend(F.lit("2024-01-07").cast("timestamp")))
    assert row.asDict() == {"a": 0, "b": 0, "fri": 0, "sat": 1, "sun": 1}


LOG = "id string, date string, user string, pc string, to string, cc string, bcc string, `from` string, " \
    "activity string, size string, attachments string, content string"


def test_raw_log_to_features(spark):
    raw = spark.createDataFrame([
        ("1", "01/02/2010 19:00:00", "u", "p", "a@dtaa.com;b@x.com", "", "", "u", "Send", "100", "f(1);g(2)", "Hello there. It is a test"),
        ("2", "broken", "u", "p", "", "", "", "u", "View", "oops", "", "keyword list"),
    ], LOG)
    rows = {r["id"]: r for r in activity_features(parse_log(raw)).collect()}
    assert (rows["1"]["attachment_count"], rows["1"]["n_recipients_external"], rows["1"]["is_weekend"]) == (2.0, 1.0, 1)
    assert (rows["2"]["size"], rows["2"]["hour_of_day"], rows["2"]["is_after_hours"]) == (None, None, 0)
    profile = profile_log(raw).first()
    assert profile.asDict() == {"total_rows": 2, "distinct_users": 1, "pct_with_attachment": 50.0, "pct_with_external": 50.0}
    size = numeric_profile(raw).filter("measure = 'size_bytes'").first()
    assert (size["n"], size["mean"], size["std"]) == (1, 100.0, 0.0)
    style = text_style(raw, "content").first()
    assert (style["n_texts"], style["pct_with_sentence_punctuation"], style["avg_word_count"]) == (2, 50.0, 4.0)
    assert profile_log(raw.limit(0)).first()["pct_with_attachment"] in (0.0, None)


def test_type_suffixes_are_no_numbers_and_dates_need_no_zeros(spark):
    row = one(spark, a=S.number(F.lit("12d")), b=S.number(F.lit("1F")), c=S.number(F.lit(" -.5e3 ")), d=S.number(F.lit(7)),
              e=S.event_time(F.lit("1/2/2010 7:05:09")).cast("string"))
    assert tuple(row) == (None, None, -500.0, 7.0, "2010-01-02 07:05:09")


def test_split_is_inclusive_and_drops_unknown_times(spark):
    rows = spark.createDataFrame(
        [("2024-01-15 23:59:59.9", 1), ("2024-01-16 00:00:00", 1), (None, 1)], "t string, is_malicious int"
    ).withColumn("ts", F.col("t").cast("timestamp"))
    train, test = split_by_time(rows, "2024-01-15")
    assert (train.count(), test.count()) == (1, 1)
    assert tuple(split_counts(rows, "2024-01-15").first()) == (1, 1, 1)


def test_expand_components(spark):
    df = spark.createDataFrame([(1, [0.5, 1.5]), (2, None)], "id int, embed_pc array<double>")
    assert [tuple(r) for r in expand_components(df, k=2).orderBy("id").collect()] == [(1, 0.5, 1.5), (2, None, None)]
