import csv
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.embed import LetterCounts, embed_text
from riskloom.sources import incidents as inc
from riskloom.sources.logs import (
    bounded_days, read_daily, read_labels, read_log, read_scores, read_split_log, read_summary,
)
from riskloom.sources.paths import first_existing
from riskloom.sources.paths import write_once
from riskloom.sources.sinks import as_summary, pointers, publish, publish_summary, publish_version, read_version
from riskloom.plans import log_queries
from riskloom.sources.archive import write_zipped_csv
from riskloom.sources.logs import read_zipped_log
from riskloom.sources.snapshots import read_snapshots, read_zipped_snapshots, snapshot_summary

COLUMNS = ["id", "user", "content"]


def log_rows(n=200):
    return [
        (f"{{{i}}}", f"u{i % 7}", f'line "one" of {i}\n\nthree, {"x" * (i % 50)}\n' if i % 3 else ("" if i % 2 else "plain"))
        for i in range(n)
    ]


def write_csv(path, header, rows, newline="\n"):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        if header:
            out.writerow(header)
        out.writerows(rows)
    return str(path)


def content(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_quoted_log(spark, tmp_path):
    path = write_csv(tmp_path / "log.csv", COLUMNS, log_rows())
    assert content(read_log(spark, path, COLUMNS)) == sorted(log_rows())


@pytest.mark.parametrize("block", [300, 1000, 10**7])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_split_log_at_any_cut(spark, tmp_path, block, newline):
    path = write_csv(tmp_path / "log.csv", COLUMNS, log_rows(), newline)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], block)
    spark.conf.set(keys[1], 1)
    try:
        got = content(read_split_log(spark, path, COLUMNS))
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert got == sorted(log_rows())


#: What csv.reader takes each record for; quotes inside an unquoted field are plain.
TRICKY = [
    ('1,u,a"b', ("1", "u", 'a"b')),
    ('2,u,"a\nb ""c""\n,d"', ("2", "u", 'a\nb "c"\n,d')),
    ('3,u,"""\n"""', ("3", "u", '"\n"')),
    ('4,u,""', ("4", "u", "")),
    ('5,"u""",x"', ("5", 'u"', 'x"')),
    ('6,,"\n\n"', ("6", "", "\n\n")),
    ('7,it""s,6" x 4"', ("7", 'it""s', '6" x 4"')),
]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [16, 64, 10**7])
def test_quotes_open_a_field_only_at_its_start(spark, tmp_path, block, newline):
    records = [(t.replace("\n", newline), tuple(v.replace("\n", newline) for v in r)) for t, r in TRICKY] * 6
    path = tmp_path / "log.csv"
    path.write_text(newline.join([",".join(COLUMNS), *[t for t, _ in records]]) + newline, newline="")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], block)
    spark.conf.set(keys[1], 1)
    try:
        got = content(read_log(spark, str(path), COLUMNS))
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert got == sorted(r for _, r in records)


def test_a_log_that_ends_inside_quotes_is_refused(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('id,user,content\n1,u,"open\n2,u,x\n')
    with pytest.raises(Exception, match="ends inside quotes"):
        read_log(spark, str(path), COLUMNS).collect()


def test_every_header_of_a_folder_is_checked(spark, tmp_path):
    write_csv(tmp_path / "a.csv", COLUMNS, [("1", "u", "x")])
    write_csv(tmp_path / "b.csv", ["user", "id", "content"], [("u", "2", "x")])
    with pytest.raises(Exception, match="do not match"):
        read_log(spark, str(tmp_path), COLUMNS).collect()


def test_columns_must_match_in_order(spark, tmp_path):
    path = write_csv(tmp_path / "log.csv", ["user", "id", "content"], [("u", "1", "x")])
    with pytest.raises(ValueError, match="do not match"):
        read_log(spark, path, COLUMNS)
    assert read_log(spark, path, ["user", "id", "content"]).count() == 1


def test_archive_is_read_in_place(spark, tmp_path):
    plain = write_csv(tmp_path / "plain.csv", COLUMNS, log_rows())
    archive = tmp_path / "log.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(plain, "email.csv")
        for month in ("2010-01", "2010-02"):
            z.writestr(f"LDAP/{month}.csv", "employee_name,user_id\nA,1\nB,2\n")
    places = [str(tmp_path / "absent.csv"), str(archive)]
    assert content(read_log(spark, places, COLUMNS)) == sorted(log_rows())
    people = read_zipped_snapshots(spark, str(archive), ["employee_name", "user_id"])
    assert tuple(snapshot_summary(people).first()) == (2, 4, 2)
    assert {r[0] for r in people.select("snapshot_month").distinct().collect()} == {"2010-01", "2010-02"}
    with pytest.raises(Exception, match="do not match"):
        read_log(spark, str(archive), ["id", "other", "content"]).count()
    with pytest.raises(FileNotFoundError):
        first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_snapshots(spark, tmp_path):
    write_csv(tmp_path / "2010-01.csv", ["user_id", "role"], [("1", "x"), ("2", "")])
    write_csv(tmp_path / "2010-02.csv", ["user_id", "role"], [("1", "y")])
    df = read_snapshots(spark, str(tmp_path / "*.csv"), ["user_id", "role"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "x", "2010-01"), ("1", "y", "2010-02"), ("2", "", "2010-01")]
    with pytest.raises(FileNotFoundError):
        read_snapshots(spark, str(tmp_path / "none*.csv"), ["user_id", "role"])
    write_csv(tmp_path / "2010-03.csv", ["role", "more", "user_id"], [("z", "m", "9"), ("a, b", "", "8")])
    (tmp_path / "2010-04.csv").write_text("")
    third = read_snapshots(spark, str(tmp_path / "*.csv"), ["user_id", "role"]).filter("snapshot_month = '2010-03'")
    assert sorted(tuple(r) for r in third.collect()) == [("8", "a, b", "2010-03"), ("9", "z", "2010-03")]
    write_csv(tmp_path / "2010-05.csv", ["user_id", "Role"], [("1", "y")])
    with pytest.raises(ValueError, match="do not match"):
        read_snapshots(spark, str(tmp_path / "*.csv"), ["user_id", "role"])


def test_archives_on_the_shared_store(spark, tmp_path):
    rows = [(str(i), None if i % 5 == 0 else f'te"xt {i},\nü') for i in range(40)]
    df = spark.createDataFrame(rows, "id string, content string").repartition(3)
    written = write_zipped_csv(df, f"file:{tmp_path}/archives").collect()
    assert sum(r["rows"] for r in written) == 40 and len(written) == 3
    for place in (f"file:{tmp_path}/archives", f"file://{tmp_path}/archives", [r["path"] for r in written]):
        got = read_zipped_log(spark, place, r"log\.csv", ["id", "content"])
        assert sorted(tuple(r) for r in got.collect()) == sorted((i, t or "") for i, t in rows)
        assert got.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="no member"):
        read_zipped_log(spark, f"{tmp_path}/archives", "other", ["id", "content"]).count()


def test_archives_grow_in_number_with_the_text(spark, sf, monkeypatch):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(log_queries, "ARCHIVE_BYTES", size // 6, raising=False)
    got = log_queries.scan_zip(spark, sf)
    assert got.rdd.getNumPartitions() in (6, 7)
    want = documents.select("doc_id", F.md5("text")).collect()
    assert sorted(tuple(r) for r in got.select("doc_id", "digest").collect()) == sorted(tuple(r) for r in want)


def test_incidents(spark, tmp_path):
    details = tmp_path / "details"
    details.mkdir()
    index = write_csv(tmp_path / "index.csv", inc.INDEX_COLUMNS, [
        ("6.2", "2", "r6.2-2.csv", "AAA", "1/2/2010 7:05:09", "12/31/2010 23:00:00"),
        ("6.2", "4", "r6.2-4.csv", "BBB", "/21/2011 11:43:39", "3/4/2011 1:00:00"),
        ("5.2", "1", "r5.2-1.csv", "CCC", "1/2/2010 7:05:09", "1/2/2010 7:05:09"),
    ])
    (details / "r6.2-2.csv").write_text(
        'email,{1},01/02/2010 07:05:09,AAA,pc,"a, b",extra,more\nlogon,{2}\n\nemail,{3}\nemail,{4},01/03/2010 08:00:00,ZZZ\n'
    )
    (details / "r5.2-1.csv").write_text("email,{9},01/02/2010 07:05:09,CCC\n")
    rows = {r["scenario"]: r for r in inc.read_incident_index(spark, index).collect()}
    assert rows["2"]["start_ts"].isoformat() == "2010-01-02T07:05:09"
    assert rows["4"]["start_ts"] is None and set(rows) == {"2", "4"}
    with pytest.raises(ValueError, match="no incident"):
        inc.read_incident_index(spark, index, "9.9")
    with pytest.warns(UserWarning, match="r6.2-4.csv"):
        labels = inc.read_incidents(spark, index, str(details / "*.csv"))
    assert sorted(tuple(r) for r in labels.collect()) == [
        ("{1}", 2, "AAA", "AAA", "01/02/2010 07:05:09"), ("{3}", 2, "AAA", "", ""),
        ("{4}", 2, "AAA", "ZZZ", "01/03/2010 08:00:00"),
    ]
    counts = {r["details"]: (r["n_rows"], r["n_matching"]) for r in inc.detail_counts(
        inc.read_detail_rows(spark, str(details / "*.csv"))).collect()}
    assert counts["r6.2-2.csv"] == (4, 3)
    assert tuple(inc.label_coverage(labels).first()) == (3, 1)


def test_versions_are_never_missing(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        read_version(spark, path)
    first = publish_version(spark.range(5), path)
    held = read_version(spark, path)
    failing = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        publish_version(failing, path)
    assert read_version(spark, path).count() == 5
    second = publish_version(spark.range(7), path)
    # a writer that died between creating its pointer and writing it
    write_once(spark, f"{path}/pointers/000000009", "")
    assert read_version(spark, path).count() == 7 and held.count() == 5
    assert read_version(spark, path, first).count() == 5
    with pytest.raises(Exception):
        write_once(spark, f"{path}/pointers/{second}", "other")
    assert publish_version(spark.range(9).withColumn("day", F.col("id") % 2), path, ["day"], keep=1) == "000000010"
    assert read_version(spark, path).count() == 9 and pointers(spark, path) == ["000000010"]
    assert len(list((tmp_path / "table" / "versions").iterdir())) <= 2


def test_publish_refuses_and_replaces(spark, tmp_path):
    path = str(tmp_path / "table")
    publish(spark.range(5), path)
    with pytest.raises(FileExistsError):
        publish(spark.range(3), path)
    publish(spark.range(3), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3
    failing = spark.range(4).select(F.raise_error(F.lit("stop")).cast("string").alias("id"))
    with pytest.raises(Exception, match="stop"):
        publish(failing, path, overwrite=True)
    assert spark.read.parquet(path).count() == 3
    publish(spark.range(4).withColumn("day", F.col("id") % 2), path, overwrite=True, partition_by=["day"])
    assert spark.read.parquet(path).filter("day = 1").count() == 2
    assert read_scores(spark, path, ["id"]).columns == ["id"]


def test_labels_daily_and_summary_round_trip(spark, tmp_path):
    labels = spark.createDataFrame(
        [("{1}", "2", "A", "B", "01/02/2010 07:05:09")], "id string, scenario string, insider_user string, email_row_user string, date string"
    )
    publish(labels, str(tmp_path / "labels"), "csv")
    row = read_labels(spark, str(tmp_path / "labels")).first()
    assert (row["id"], row["scenario"]) == ("{1}", 2)
    with pytest.raises(FileNotFoundError):
        read_labels(spark, str(tmp_path / "absent"))
    daily = spark.createDataFrame([("2010-08-01", 0.1, 3), ("2010-08-01", 0.05, 1)], "date string, budget double, true_positives int")
    publish(daily, str(tmp_path / "daily"), "csv")
    assert [r["true_positives"] for r in read_daily(spark, str(tmp_path / "daily"), 0.05).collect()] == [1]
    assert read_daily(spark, str(tmp_path / "daily")).count() == 2
    per_budget = daily.select(F.col("budget"), "true_positives", F.lit(1).alias("reviewed"))
    publish_summary(as_summary(per_budget, "budget", "budget_metrics"), str(tmp_path / "summary"))
    back = read_summary(spark, str(tmp_path / "summary")).first()["budget_metrics"]
    assert back["0.1"]["true_positives"] == 3
    with pytest.raises(FileNotFoundError):
        read_summary(spark, str(tmp_path / "nothing"))


def test_bounded_days(spark):
    df = spark.range(50).withColumn("day", F.col("id") % 5)
    assert bounded_days(df, "day", 2).count() == 20


def test_encoder_is_built_once_per_task_and_batches(spark):
    class Lengths:
        built = 0

        def __init__(self):
            Lengths.built += 1

        def encode(self, texts):
            assert len(texts) <= 3
            return np.array([[len(t), Lengths.built] for t in texts], dtype=float)

    texts = [("a" * i if i else None,) for i in range(20)]
    df = spark.createDataFrame(texts, "t string").coalesce(1)
    rows = embed_text(df, "t", Lengths, batch_size=3).collect()
    assert [r["embedding"] for r in rows] == [[float(i), 1.0] for i in range(20)]
    assert embed_text(df.limit(0), "t", LetterCounts).count() == 0


def test_a_quoted_line_break_in_a_detail_row_makes_no_row(spark, tmp_path):
    from riskloom.sources.incidents import read_detail_rows

    (tmp_path / "r1.csv").write_text('email,{1},d,u,"a\nemail,{9},x"\nemail,{2},d,u\n')
    assert sorted(r["id"] for r in read_detail_rows(spark, str(tmp_path)).collect()) == ["{1}", "{2}"]


def test_a_failed_swap_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    from riskloom.sources import sinks

    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path)
    real, calls = sinks.move, []

    def move(s, a, b):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("store away")
        real(s, a, b)

    monkeypatch.setattr(sinks, "move", move)
    with pytest.raises(OSError):
        sinks.publish(spark.range(9), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3


def test_daily_series_read_both_ways_of_writing_a_day(spark, tmp_path):
    from riskloom.sources.logs import read_daily

    (tmp_path / "d.csv").write_text("date,budget,true_positives\n08/01/2010,0.01,3\n2010-08-02,0.01,4\n08/03/2010,0.05,5\n?,0.01,6\n")
    got = {str(r["day"]): r["true_positives"] for r in read_daily(spark, str(tmp_path), 0.01).collect()}
    assert got == {"2010-08-01": 3, "2010-08-02": 4, "None": 6}
