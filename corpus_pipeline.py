"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, jaccard_join, langid, packing, suffix_array
from riskloom.session import materialize

#: Texts of which the likeliest language holds a smaller part of the n-grams are no language.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; those without letters or in none go."""
    found = langid.identify(docs)
    return found.filter((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LEAST_SCORE)).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_per_group(docs)


def without_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand anywhere else; ``n_chars`` follows the text."""
    cut = suffix_array.remove_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("shared_passages", without_shared_passages),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Language models, tokenizers and packing are beyond SQL; a test holds the rows of all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``, each stage's rows written before the next reads them.

    Null and empty texts go in the first stage, so an empty table, or one without letters, packs
    nothing. Rows of one id and text count as copies. Other columns ride along until the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
