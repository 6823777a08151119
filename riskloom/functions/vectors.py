"""Moving vector columns between Arrow batches and numpy without per-row objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_packed(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.BinaryType)


def packed(df: DataFrame, column: str) -> DataFrame:
    """Vectors of floats as the bytes of their elements, a null element as NaN; null vectors and all other columns as they are.

    Shuffles, sorts, files and Arrow batches then move a vector as one value and not element by element. Vectors of
    another type stay lists. ``usable_matrix`` and ``known_matrix`` read either form.
    """
    if df.schema[column].dataType.simpleString() != "array<float>":
        return df
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.set_column(place, column, vector_bytes(part.column(place)))

    fields = [T.StructField(column, T.BinaryType()) if f.name == column else f for f in df.schema.fields]
    return df.mapInArrow(run, T.StructType(fields))


def unpacked(df: DataFrame, column: str) -> DataFrame:
    """Packed vectors as lists of floats again."""
    if not is_packed(df, column):
        return df
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.set_column(place, column, vector_lists(part.column(place)))

    fields = [T.StructField(column, T.ArrayType(T.FloatType())) if f.name == column else f for f in df.schema.fields]
    return df.mapInArrow(run, T.StructType(fields))


def vector_bytes(column: pa.Array) -> pa.Array:
    """A list column of floats as their little-endian bytes."""
    values = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype("<f4", copy=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * 4
    data = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])
    return pc.if_else(column.is_valid(), data, None) if column.null_count else data


def vector_lists(column: pa.Array) -> pa.Array:
    """A vector column as lists; of a packed one the floats stay where they are in memory."""
    if not pa.types.is_binary(column.type):
        return column
    if not len(column):
        return pa.array([], pa.list_(pa.float32()))
    present, places, data = column.buffers()
    ends = np.frombuffer(places, np.int32, column.offset + len(column) + 1) // 4
    values = pa.Array.from_buffers(pa.float32(), int(ends[-1]), [None, data])
    return pa.Array.from_buffers(
        pa.list_(pa.float32()), len(column), [present, pa.py_buffer(ends.tobytes())], offset=column.offset, children=[values])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as an ``n x dims`` array of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(len(column), dims)


def usable_matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as an ``n x dims`` array of doubles. A row that is null, of another length, or holds a null
    or NaN is zero throughout."""
    column = vector_lists(column)
    fine = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    places = np.flatnonzero(fine.to_numpy(zero_copy_only=False))
    if len(places) < len(column):
        column = column.filter(fine)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(places), dims)
    known = ~np.isnan(values).any(axis=1)
    if len(places) == len(fine) and known.all():
        return values
    rows = np.zeros((len(fine), dims))
    rows[places[known]] = values[known]
    return rows


def known_matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The first ``dims`` elements of a list column as an ``n x dims`` array of doubles. What a row lacks or is no
    finite number is NaN."""
    column = vector_lists(column)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        rows = values.reshape(len(column), dims)
    else:
        rows = np.full((len(column), dims), np.nan)
        place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inside = place < dims
        rows[np.repeat(np.arange(len(column)), lengths)[inside], place[inside]] = values[inside]
    return np.where(np.isfinite(rows), rows, np.nan)


def lists(rows: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """An ``n x dims`` array as a list column; rows not ``present`` are null."""
    n, dims = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dims)
    if present is None or present.all():
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
    mask = np.concatenate([~present, [False]])
    kept = rows[present].ravel()
    starts = np.concatenate([[0], np.cumsum(np.where(present, dims, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts, mask=mask), pa.array(kept))


def vector_sum(column: str, dims: int, name: str | None = None, start: int = 0) -> Column:
    """Element-wise sum of a list column as an aggregate, combined before the shuffle."""
    parts = ", ".join(f"sum(double(`{column}`[{i}]))" for i in range(start, start + dims))
    return F.expr(f"array({parts})").alias(name or column)


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])
