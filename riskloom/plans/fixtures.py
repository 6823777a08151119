"""The activity log that the queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions.vectors import packed
from riskloom.operators.anomaly import fit_user_stats, score_anomaly
from riskloom.operators.bandit import fit_scaler, scale_context
from riskloom.operators.features import activity_features, split_by_time
from riskloom.operators.semantic import semantic_deviation
from riskloom.session import clustered, materialize

DOMAIN = "corp.example"
TRAIN_END = "2024-01-15"
FIRST_TEST_DAY = "2024-01-16"
BUDGETS = [0.001, 0.005, 0.01, 0.05, 0.10]
DIMS = 64
EMBED_CONTEXT = [f"embed_{i}" for i in range(DIMS)]
CONTEXT = [*C.BASE_CONTEXT, *EMBED_CONTEXT]
LABEL_TYPE = "error"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prop():
    return F.get_json_object("props", "$.k").cast("int")


def activity(spark: SparkSession, sf: str, embedding: bool = False, pack: bool = False) -> DataFrame:
    """The log. Vectors are joined only where a query reads them, with ``pack`` as bytes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    log = from_events(table(spark, sf, "events"))
    return with_vectors(log, table(spark, sf, "embeddings"), pack) if embedding else log


def with_content(log: DataFrame, documents: DataFrame) -> DataFrame:
    wanted = F.col("id") % F.lit(documents.count())
    texts = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("content"))
    return log.join(texts, wanted == F.col("_doc")).drop("_doc")


def with_vectors(log: DataFrame, vectors: DataFrame, pack: bool = False) -> DataFrame:
    wanted = F.col("id") % F.lit(vectors.count())
    vectors = vectors.select(F.col("vec_id").alias("_vec"), "embedding")
    return log.join(packed(vectors, "embedding") if pack else vectors, wanted == F.col("_vec")).drop("_vec")


def busiest(spark: SparkSession, sf: str) -> int | None:
    """The most events of a user, from one column of the table: each has one vector at most."""
    return activity(spark, sf).groupBy("user").count().agg(F.max("count")).first()[0]


def from_events(events: DataFrame) -> DataFrame:
    k = F.col("k")
    malicious = (F.col("event_type") == LABEL_TYPE) & (k >= 95)
    return events.withColumn("k", prop()).withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("user_id").alias("user"),
        "ts", F.to_date("ts").alias("day"), F.col("event_type").alias("activity"),
        F.col("value").alias("size"),
        F.concat(
            F.repeat(F.lit("a@corp.example;"), k % 3),
            F.when(k % 5 == 0, "x@ext.example").otherwise("c@corp.example"),
        ).alias("to"),
        F.when(k % 2 == 0, "b@CORP.example").otherwise("").alias("cc"),
        F.lit("").alias("bcc"),
        F.when(
            k % 4 == 0,
            F.concat(F.repeat(F.lit("C:\\d\\f.doc(10);"), k % 3), F.lit("C:\\d\\g.doc(20)")),
        ).otherwise("").alias("attachments"),
        malicious.cast("int").alias("is_malicious"),
        F.when(malicious, 2 + k % 3).otherwise(0).alias("scenario"),
        "k",
    )


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled events, and three ids that the log does not hold."""
    log = activity(spark, sf)
    real = log.filter("is_malicious = 1").select("id", "scenario", F.col("user").alias("insider_user"))
    absent = (
        log.agg(F.min("id").alias("low"))
        .select(F.explode(F.array(*[F.col("low") - i for i in (1, 2, 3)])).alias("id"))
        .select("id", F.lit(2).alias("scenario"), F.lit(0).cast("bigint").alias("insider_user"))
    )
    return real.unionByName(absent)


KEYS = ("id", "seq", "user", "ts", "day", "is_malicious", "scenario")


def features(spark: SparkSession, sf: str, vector: bool = False) -> DataFrame:
    """The feature table, written once: its window over vectors is the costly part. With ``vector`` it
    holds the vectors too, packed, which only contexts read."""
    log = activity(spark, sf, embedding=True, pack=True)
    meta = activity_features(log, DOMAIN, keep=(*KEYS, "embedding"))
    keep = tuple(c for c in meta.columns if vector or c != "embedding")
    return materialize(semantic_deviation(meta, dims=DIMS, keep=keep, largest=busiest(spark, sf)), "features")


def scores(spark: SparkSession, sf: str, feats: DataFrame | None = None) -> DataFrame:
    """Static scores of the test rows."""
    feats = feats if feats is not None else features(spark, sf)
    train, test = split_by_time(feats, TRAIN_END)
    stats = fit_user_stats(train)
    return score_anomaly(test, stats, keep=KEYS)


def written_scores(spark: SparkSession, sf: str, feats: DataFrame | None = None) -> DataFrame:
    return materialize(scores(spark, sf, feats), "scores")


def contexts(spark: SparkSession, sf: str, feats: DataFrame | None = None, by_day: bool = False) -> DataFrame:
    """Bandit contexts of the test rows. For a write ``by_day`` the rows are arranged before they are scaled, with
    their vectors as they came."""
    feats = feats if feats is not None else features(spark, sf, vector=True)
    train, test = split_by_time(feats, TRAIN_END)
    scaler = fit_scaler(train, C.BASE_CONTEXT, vector="embedding", dims=DIMS)
    keep = ["id", "seq", "user", "day", "is_malicious", "scenario"]
    if by_day:
        test = clustered(test.select(*keep, *C.BASE_CONTEXT, "embedding"), ["day"])
    return scale_context(test, scaler, keep)


def day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})
