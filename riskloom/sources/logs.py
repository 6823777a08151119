"""Reading the activity log and the tables the pipeline publishes."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskloom import constants as C
from riskloom.session import materialize
from riskloom.sources.paths import exists, first_existing

QUOTED_CSV = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def csv_name():
    """The name of the CSV a row came from, be it one file or a folder of part files."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+\.csv)(/[^/]*)?$", 1)


def check_columns(actual: list[str], expected: list[str]) -> None:
    """Names must match in order; anything else is a different log."""
    if list(actual) != list(expected):
        raise ValueError(f"log columns do not match\nexpected: {expected}\nfound:    {list(actual)}")


def _header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of the log. Reads one line, not the file."""
    first = spark.read.text(path).first()
    return next(csv.reader([first[0]]), []) if first else []


def read_log(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    strict: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """Scan a quoted CSV log: every column as text, empty text kept as ``""``.

    ``path`` may be a list of places; the first that exists is read, and a place
    that ends in ``.zip`` is read through the archive source. ``multiline`` allows
    line breaks inside quotes and reads each file in many tasks (``read_split_log``);
    without it a line is a record.
    """
    columns = columns or C.LOG_COLUMNS
    path = first_existing(spark, [path] if isinstance(path, str) else path)
    if path.endswith(".zip"):
        return read_zipped_log(spark, path, columns=columns, strict=strict)
    if multiline:
        return read_split_log(spark, path, columns, strict)
    if strict:
        check_columns(_header(spark, path), columns)
    # the header of every file is held against the names, not only the first
    reader = spark.read.schema(text_schema(columns)).options(**QUOTED_CSV).option("enforceSchema", str(not strict).lower())
    return reader.csv(path).na.fill("")


def _opens(text):
    """Whether a line that begins a field ends inside quotes.

    A quote opens a field only at its first character; ``""`` inside quotes is one
    quote; after the closing one a field runs to the next comma. Pairs are taken out
    first, which changes no field's state, then every field that ends at a comma.
    """
    single = F.replace(text, F.lit('""'), F.lit(""))
    last = F.regexp_replace(single, r'\G(?:"[^"]*+"[^,]*+|[^",][^,]*+)?+,', "")
    return F.contains(single, F.lit('"')) & last.rlike(r'^"[^"]*+$')


def read_split_log(
    spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = True
) -> DataFrame:
    """Scan a quoted CSV log with line breaks in quotes, many tasks per file.

    Spark cannot split such a file, as a cut may fall inside quotes. Here the file
    is read as plain lines, which does split. What a line does to the quotes is worked
    out for both states it may begin in, so a split knows its own effect without its
    neighbours; a table of one row per split then tells each the state it begins in.
    The text is scanned twice, for the effects and for the records, and both results are written; if the
    scans should differ in their splits or lines, that is an error. The text is shuffled once, by
    split, where the lines of a record are joined. Only the lines in front of a split's first record
    move again, to the record they end.

    A quote inside an unquoted field is plain text. Empty lines are skipped. With
    ``strict`` a header that differs is an error, in any file. A file that ends inside
    quotes is always one.
    """
    columns = columns or C.LOG_COLUMNS
    if strict:
        check_columns(_header(spark, path), columns)
    split = ["file", "block"]
    in_split = Window.partitionBy(*split).orderBy("at")
    until = in_split.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    closed, opened = _opens(F.col("value")), _opens(F.concat(F.lit('"'), "value"))
    # A line sets the state (one end from both beginnings), turns it or leaves it.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.when(closed == opened, closed.cast("int")).alias("sets"),
        (closed & ~opened).cast("int").alias("turns"),
    )
    turned = lines.withColumn("turned", F.sum("turns").over(until)).withColumn(
        "base", (F.col("sets") + F.col("turned")) % 2  # the first state that would end here as it was set
    )
    effect = materialize(turned.groupBy(*split).agg(
        F.max_by("base", F.when(F.col("base").isNotNull(), F.col("at"))).alias("base"),
        F.sum("turns").alias("turned"), F.count(F.lit(1)).alias("n"),
    ), "split-effects")
    # The same rule once more, with a split in the place of a line: one row per split, so
    # that a file of a petabyte in 128 MB splits has eight million.
    in_file = Window.partitionBy("file").orderBy("block")
    splits_until = in_file.rowsBetween(Window.unboundedPreceding, 0)
    splits = (
        effect.withColumn("sets", (F.col("base") + F.col("turned")) % 2)
        .withColumn("all_turned", F.sum("turned").over(splits_until))
        .withColumn("all_base", F.last((F.col("sets") + F.col("all_turned")) % 2, ignorenulls=True).over(splits_until))
        .withColumn("ends", (F.coalesce("all_base", F.lit(0)) + F.col("all_turned")) % 2)
        .select(
            *split,
            F.when(F.lead("block").over(in_file).isNull() & (F.col("ends") == 1),
                   F.raise_error(F.concat(F.lit("the log ends inside quotes: "), "file")).cast("int"))
            .otherwise(F.coalesce(F.lag("ends").over(in_file), F.lit(0))).alias("begins"),
        )
    )
    state = F.coalesce(F.last("base", ignorenulls=True).over(earlier), F.col("begins"))
    turns_before = F.coalesce(F.sum("turns").over(earlier), F.lit(0))
    records = (
        turned.join(splits, split)
        .withColumn("starts", 1 - (state + turns_before) % 2)
        .withColumn("record", F.sum("starts").over(until))
        .groupBy(*split, "record")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
        .select(*split, "record", F.size("parts").alias("n"),
                F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("line"))
    )
    records = materialize(records, "split-records")
    counted = records.groupBy(*split).agg(F.sum("n").alias("now")).join(effect.select(*split, "n"), split, "full_outer")
    differs = counted.filter(~F.col("now").eqNullSafe(F.col("n"))).first()
    if differs:
        raise OSError(f"the two scans of {differs['file']} saw other splits or lines; read it again")
    return _parse_records(records, columns, strict)


def _parse_records(records: DataFrame, columns: list[str], strict: bool) -> DataFrame:
    """Records of ``read_split_log`` put back whole, and parsed. Record 0 of a split ends an earlier one's last."""
    in_file = Window.partitionBy("file").orderBy("block")
    owners = (
        records.groupBy("file", "block").agg(F.max("record").alias("last"), F.min("record").alias("first"))
        .withColumn("own", F.when(F.col("last") > 0, F.struct("block", "last")))
        .withColumn("owner", F.last("own", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("first = 0")
        .select("file", "block", F.col("owner.block").alias("to_block"), F.col("owner.last").alias("to_record"))
    )
    ends = (
        records.filter("record = 0").join(owners, ["file", "block"])
        .groupBy("file", F.col("to_block").alias("block"), F.col("to_record").alias("record"))
        .agg(F.array_sort(F.collect_list(F.struct("block", "line"))).alias("parts"))
        .select("file", "block", "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("end"))
    )
    whole = records.filter("record > 0").join(ends, ["file", "block", "record"], "left").select(
        ((F.col("block") == 0) & (F.col("record") == 1)).alias("header"),
        F.rtrim(F.concat_ws("\n", "line", "end"), F.lit("\r")).alias("line"),
    )
    ddl = ", ".join(f"`{c}` string" for c in columns)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    parsed = whole.filter(F.col("line") != "").select("header", F.from_csv("line", F.lit(ddl), options).alias("r"))
    named = F.array(*[F.col("r")[c] for c in columns]) == F.array(*[F.lit(c) for c in columns])
    if strict:
        wrong = F.raise_error(F.concat(F.lit("log columns do not match: "), F.to_json("r"))).cast("boolean")
        named = F.when(F.coalesce(named, F.lit(False)), F.lit(True)).otherwise(wrong)
    else:
        named = F.lit(True)
    return parsed.filter(F.when(F.col("header"), ~named).otherwise(F.lit(True))).select("r.*").na.fill("")


def read_zipped_log(
    spark: SparkSession,
    archive: str | list[str],
    member: str = r"(.*/)?email\.csv",
    columns: list[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Scan members of zip archives in place, on any store that the workers can open. ``archive`` is one archive, a folder
    of them or a list. A deflated member is one stream, so each is one task; land the result once with
    ``publish`` and work from there."""
    from riskloom.sources.archive import ZippedCsvSource

    spark.dataSource.register(ZippedCsvSource)
    columns = columns or C.LOG_COLUMNS
    return (
        spark.read.format("zipped_csv")
        .schema(text_schema(columns))
        .option("member", member).option("strict", str(strict).lower())
        .option("archives", json.dumps([archive] if isinstance(archive, str) else list(archive))).load()
    )


def bounded_prefix(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The first rows of the log in time order, for a development run."""
    return df.orderBy(*order).limit(rows)


def bounded_days(df: DataFrame, day: str, days: int) -> DataFrame:
    """The first days of the log; on a table partitioned by day, only they are read."""
    first = [r[0] for r in df.select(day).distinct().orderBy(day).limit(days).collect()]
    return df.filter(F.col(day).isin(first))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label lookup: ``id, scenario, insider_user, email_row_user, date``."""
    columns = ["id", "scenario", "insider_user", "email_row_user", "date"]
    if not exists(spark, path):
        raise FileNotFoundError(f"no label lookup at {path}; build it with read_incidents first")
    raw = spark.read.schema(text_schema(columns)).options(**QUOTED_CSV).csv(path).na.fill("")
    return raw.withColumn("scenario", F.col("scenario").try_cast("int"))


def read_scores(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_daily(spark: SparkSession, path: str, budget: float | None = None) -> DataFrame:
    """A daily series, for one budget when given. Budgets match within 1e-12.

    Days read ``08/31/2010`` or ``2010-08-31``; another text becomes null.
    """
    raw = spark.read.options(**QUOTED_CSV).csv(path)
    if budget is not None:
        raw = raw.filter(F.abs(F.col("budget").cast("double") - F.lit(float(budget))) < 1e-12)
    return raw.select(
        F.to_date(F.coalesce(F.try_to_timestamp("date", F.lit("M/d/yyyy")),
                             F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))).alias("day"),
        F.col("true_positives").cast("bigint").alias("true_positives"),
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A run summary written by ``publish_summary`` or any single JSON document."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no run summary at {path}")
    return spark.read.option("multiLine", "true").json(path)
