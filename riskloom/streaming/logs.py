"""Streaming sources, and running a stream to its present end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from riskloom.functions.schemas import extended
from riskloom.session import fresh_path


def read_log_stream(
    spark: SparkSession, path: str, schema: StructType, name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a Parquet log as they arrive; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, step, mode: str = "append", checkpoint: str | None = None) -> None:
    """Run every micro-batch that is available through ``step(batch, batch_id)``.

    ``step`` may see a batch id again after a failure and must then write the same
    thing to the same place.
    """
    checkpoint = checkpoint or fresh_path(stream.sparkSession, "stream-checkpoint")
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_table(stream: DataFrame, label: str) -> DataFrame:
    """Run an aggregated stream and return its last complete result."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    run_to_end(stream, lambda batch, _: batch.write.mode("overwrite").parquet(path), "complete")
    return spark.read.schema(stream.schema).parquet(path)


def closed_rows(stream: DataFrame, label: str) -> DataFrame:
    """Run an aggregated stream in append mode: what its watermark has closed, each group once."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    run_to_end(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    return spark.read.schema(extended(stream.schema, "batch bigint")).parquet(path).drop("batch")
