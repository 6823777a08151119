"""Causal dimension reduction: each batch is projected on a basis of earlier batches.

The basis of batch i is the exact principal basis of every row in batches before i,
from running sums of vectors and of their products. Batches with fewer rows than
components are projected but never teach the basis. The batch is a column of the
data, usually the day; the choice of batch changes the basis, so it is an argument.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import WindowSpec

from riskloom.functions.schemas import extended
from riskloom.functions.vectors import lists, matrix, vector_sum
from riskloom.operators.semantic import vector_dims
from riskloom.session import materialize

OPEN_BATCHES = 32
#: Batches whose sums one window adds up; blocks of them are added up before.
BATCHES_PER_BLOCK = 256
#: Rows of a batch that one task projects, about.
ROWS_PER_PROJECTION = 50_000


def batch_vector_moments(df: DataFrame, batch: str, embedding: str, dims: int | None = None) -> DataFrame:
    """Per batch and vector element ``i``: rows, the sum, and row ``i`` of the sum of x xT.

    Every task adds up its own rows, so the shuffle carries sums, not vectors. A task
    keeps at most ``OPEN_BATCHES`` batches in memory and emits them when more come.
    """
    dims = dims or vector_dims(df, embedding)
    schema = extended(df.select(batch).schema, "i int, n bigint, v array<double>")

    key_type = to_arrow_type(df.schema[batch].dataType)

    def emit(sums: dict) -> Iterator[pa.RecordBatch]:
        for key, (n, total, gram) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * dims, key_type), pa.array(np.arange(dims, dtype=np.int32)),
                    pa.array([n] * dims, pa.int64()), lists(np.hstack([total[:, None], gram])),
                ],
                names=[batch, "i", "n", "v"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for rows in batches:
            x = matrix(rows.column(embedding), dims)
            keys = rows.column(batch).to_pandas()
            for key, index in keys.groupby(keys).indices.items():
                part = x[index]
                n, total, gram = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(part), total + part.sum(axis=0), gram + part.T @ part)
            if len(sums) > OPEN_BATCHES:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    partial = df.select(batch, embedding).filter(F.col(embedding).isNotNull()).mapInArrow(run, schema)
    return partial.groupBy(batch, "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("v")[0]).alias("total"), vector_sum("v", dims, "gram", start=1)
    )


def batch_blocks(moments: DataFrame, batch: str, per_block: int) -> DataFrame:
    """(_of, _block): ranges of consecutive batches, written once so that every later step sees the same."""
    keys = moments.filter("i = 0").select(F.col(batch).alias("_of"))
    parts = max(1, math.ceil(keys.count() / per_block))
    return materialize(keys.repartitionByRange(parts, "_of").withColumn("_block", F.spark_partition_id()), "batch-blocks")


def causal_batch_moments(
    moments: DataFrame, batch: str, dims: int, k: int, per_block: int = BATCHES_PER_BLOCK
) -> DataFrame:
    """The same sums over all earlier batches that have at least ``k`` rows.

    A prefix sum on two levels: the totals of blocks of batches are added up first, then each block adds up its
    batches from its own start. No window sees more than a block's batches, or one row per block.
    """
    learns = F.col("n") >= k
    placed = moments.join(batch_blocks(moments, batch, per_block), F.col(batch).eqNullSafe(F.col("_of"))).drop("_of")
    taught = placed.select(
        batch, "i", "_block", *[F.when(learns, F.col(c)).alias(c) for c in ("n", "total", "gram")])
    whole = taught.groupBy("_block", "i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), vector_sum("gram", dims))

    def before(window: WindowSpec, c: str | Column) -> Column:
        return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def sums(window: WindowSpec) -> list[Column]:
        gram = F.array(*[before(window, F.col("gram")[j]).cast("double") for j in range(dims)])
        return [before(window, "n").alias("n"), before(window, "total").cast("double").alias("total"), gram.alias("gram")]

    starts = whole.select("_block", "i", *sums(Window.partitionBy("i").orderBy("_block")))
    starts = starts.withColumnsRenamed({c: f"_{c}" for c in ("n", "total", "gram")})
    inside = taught.select(batch, "i", "_block", *sums(Window.partitionBy("_block", "i").orderBy(batch)))
    return inside.join(starts, ["_block", "i"]).select(
        batch, "i", (F.col("n") + F.col("_n")).alias("n"), (F.col("total") + F.col("_total")).alias("total"),
        F.zip_with("gram", "_gram", lambda a, b: a + b).alias("gram"))


def principal_basis(n: int, total: np.ndarray, gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k leading directions; the largest loading of each is positive."""
    mean = total / n
    values, vectors = np.linalg.eigh(gram / n - np.outer(mean, mean))
    top = vectors[:, np.argsort(values)[::-1][:k]].T
    largest = np.abs(top).argmax(axis=1)
    return mean, top * np.sign(top[np.arange(len(top)), largest])[:, None]


def causal_bases(prefix: DataFrame, batch: str, k: int) -> DataFrame:
    """One basis per batch that has a history: a d x d problem each, on the executors."""
    schema = extended(prefix.select(batch).schema, "mean array<double>, components array<double>")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        mean, components = principal_basis(
            int(rows["n"].iloc[0]), rows["total"].to_numpy(), np.stack(rows["gram"].to_numpy()), k
        )
        return pd.DataFrame({
            batch: [rows[batch].iloc[0]], "mean": [mean], "components": [components.ravel()],
        })

    return prefix.filter(F.col("n") > 0).groupBy(batch).applyInPandas(solve, schema)


def project(
    df: DataFrame, batch: str, embedding: str, bases: DataFrame, k: int, dims: int, output: str,
    rows_per_group: int = ROWS_PER_PROJECTION,
) -> DataFrame:
    """Project rows on the basis of their batch; rows of a batch without one get null.

    Rows meet their basis by batch. A batch of more than ``rows_per_group`` rows is dealt to several
    groups by a hash of its rows, each with a copy of the basis.
    """
    parts = df.groupBy(F.col(batch).alias("_of")).agg(F.ceil(F.count(F.lit(1)) / rows_per_group).alias("_parts"))
    parts = materialize(parts.filter("_parts > 1"), "large-batches")
    split = F.coalesce("_parts", F.lit(1))

    def with_parts(rows: DataFrame) -> DataFrame:
        return rows.join(parts, F.col(batch).eqNullSafe(F.col("_of")), "left")

    rows = with_parts(df).withColumn("_part", F.pmod(F.xxhash64(*df.columns), split)).drop("_of", "_parts")
    copies = with_parts(bases).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), split - 1)))
    copies = copies.select(batch, "_part", "mean", "components")
    schema = extended(df.schema, f"`{output}` array<double>")

    def run(table: pa.Table, basis: pa.Table) -> pa.Table:
        column = table.column(embedding).combine_chunks()
        out = lists(np.zeros((len(table), k)), np.zeros(len(table), dtype=bool))
        if len(basis) and len(table):
            mean = np.array(basis.column("mean")[0].as_py())
            components = np.array(basis.column("components")[0].as_py()).reshape(k, -1)
            present = column.is_valid().to_numpy(zero_copy_only=False)
            values = np.zeros((len(table), k))
            values[present] = (matrix(column.drop_null(), dims) - mean) @ components.T
            out = lists(values, present)
        return table.drop_columns(["_part"]).append_column(output, out)

    return rows.groupBy(batch, "_part").cogroup(copies.groupBy(batch, "_part")).applyInArrow(run, schema)


def causal_pca(
    df: DataFrame, batch: str, embedding: str, k: int, output: str = "embed_pc", dims: int | None = None,
    least: int | None = None, per_block: int = BATCHES_PER_BLOCK, rows_per_group: int = ROWS_PER_PROJECTION,
) -> DataFrame:
    """Add ``output``: k causal components of ``embedding``, null in the first batch.

    Batches of fewer than ``least`` rows (by default k) teach no basis. Bases are a written table
    of ``batches * (k + 1) * d`` numbers that never leaves the executors. Rows with a null vector, and
    all rows of a batch before the first that teaches, get null; an empty table stays empty.
    """
    dims = dims or vector_dims(df, embedding)
    moments = materialize(batch_vector_moments(df, batch, embedding, dims), "batch-moments")
    prefix = causal_batch_moments(moments, batch, dims, k if least is None else least, per_block)
    bases = materialize(causal_bases(prefix, batch, k), "causal-bases")
    return project(df, batch, embedding, bases, k, dims, output, rows_per_group)
