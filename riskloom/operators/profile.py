"""Profiling the log: counts, numeric summaries and the text style check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import scalars as S


def numeric_summary(col: Column) -> list[Column]:
    """Count, mean, population deviation, least and greatest of the finite values."""
    return [
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    ]


def log_measures(df: DataFrame, domain: str, anchored: bool = False) -> DataFrame:
    """The per-row numbers that the profile summarises, and nothing else."""
    internal = sum((S.internal_items(F.col(c), domain, anchored) for c in C.RECIPIENT_COLUMNS), F.lit(0))
    total = sum((S.list_items(F.col(c)) for c in C.RECIPIENT_COLUMNS), F.lit(0))
    return df.select(
        "user", "activity",
        S.number(F.col("size")).alias("size_bytes"),
        S.list_items(F.col("attachments")).cast("double").alias("attachments_per_row"),
        internal.cast("double").alias("recipients_internal"),
        (total - internal).cast("double").alias("recipients_external"),
    )


MEASURES = ["size_bytes", "attachments_per_row", "recipients_internal", "recipients_external"]


def profile_log(df: DataFrame, domain: str = C.INTERNAL_DOMAIN, approximate_users: bool = False) -> DataFrame:
    """One row: rows, distinct users, attachment and external-recipient shares.

    The exact distinct count shuffles one row per user after map-side combining;
    ``approximate_users`` trades it for a sketch.
    """
    measures = log_measures(df, domain)
    users = F.approx_count_distinct("user") if approximate_users else F.countDistinct("user")
    rows = F.greatest(F.count(F.lit(1)), F.lit(1))

    def share(flag: Column) -> Column:
        return F.round(F.lit(100.0) * F.count_if(flag) / rows, 2)

    return measures.agg(
        F.count(F.lit(1)).alias("total_rows"),
        users.alias("distinct_users"),
        share(F.col("attachments_per_row") > 0).alias("pct_with_attachment"),
        share(F.col("recipients_external") > 0).alias("pct_with_external"),
    )


#: Sketches of 2^12 registers: two of three estimates are within 1.6 %.
SKETCH_BITS = 12


def daily_sketches(df: DataFrame, by: str | Column = "day", user: str = "user", bits: int = SKETCH_BITS) -> DataFrame:
    """Per day its rows and a mergeable sketch of its distinct users, to be stored and united later.

    A few kilobytes per day, combined before the shuffle, on a stream as in batch. Null users are not counted.
    """
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(user, F.lit(bits)).alias("users"))


def united_users(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Rows and estimated distinct users of any range of days, out of stored sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("approx_users"))


def numeric_profile(df: DataFrame, domain: str = C.INTERNAL_DOMAIN) -> DataFrame:
    """One row per measure with its summary, from a single scan."""
    measures = log_measures(df, domain)
    wide = measures.agg(*[F.struct(*numeric_summary(F.col(m))).alias(m) for m in MEASURES])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("s")) for m in MEASURES])
    return wide.select(F.explode(rows).alias("r")).select("r.measure", "r.s.*")


def activity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("activity").agg(F.count(F.lit(1)).alias("n_rows"))


def text_style(df: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """Whether the texts read as sentences or as bare keywords, over all rows.

    The examples are the rows with the least id digests, so they are the same in every run.
    """
    # a word is a run of a-z and apostrophes; no list of a text's words is made
    lowered, common = F.lower(text), "|".join(C.STOPWORDS)
    marks = df.select(
        F.col(text).rlike("[.!?]").cast("int").alias("sentence"),
        lowered.rlike(f"(?<![a-z'])(?:{common})(?![a-z'])").cast("int").alias("stopword"),
        F.regexp_count(lowered, F.lit("[a-z']++")).alias("words"),
    )
    few = df.select(F.md5(F.col(id_col).cast("string")).alias("_digest"), id_col,
                    F.substring(text, 1, C.SNIPPET_CHARS).alias("snippet")).orderBy("_digest", id_col).limit(C.SNIPPETS)
    head = few.agg(F.transform(F.array_sort(F.collect_list(F.struct("_digest", id_col, "snippet"))),
                               lambda s: s["snippet"]).alias("example_snippets"))
    counts = marks.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.round(100 * F.avg("sentence"), 1).alias("pct_with_sentence_punctuation"),
        F.round(100 * F.avg("stopword"), 1).alias("pct_containing_common_stopwords"),
        F.round(F.avg("words"), 1).alias("avg_word_count"),
    )
    return counts.crossJoin(F.broadcast(head))  # one row each
