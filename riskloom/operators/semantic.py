"""How far an event departs from what its user has done before.

The deviation of an event is the cosine distance of its vector from the mean of the
user's earlier vectors. Cosine ignores scale, so the running sum serves as well as
the mean. The first event of a user has no history and gets null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import Key, ordered_slots
from riskloom.functions.schemas import extended
from riskloom.functions.vectors import is_packed, unpacked, usable_matrix, vector_sum, with_column

# One window expression per dimension costs more to compile than to run: with 64 of
# them, ten seconds before the first row. Beyond this many, a sorted pass with vector
# arithmetic in Arrow batches is used; it measured four times faster at 64.
MAX_WINDOW_DIMS = 16

# A row with its vector is half a kilobyte and more; this is a usual partition's worth.
VECTOR_ROWS_PER_TASK = 250_000


def vector_dims(df: DataFrame, embedding: str) -> int:
    length = (F.octet_length(embedding) / 4).cast("int") if is_packed(df, embedding) else F.size(embedding)
    row = df.filter(F.col(embedding).isNotNull()).select(length).first()
    if row is None:
        raise ValueError(f"no vector in column {embedding}")
    return row[0]


def usable(embedding: str, dims: int):
    """The vector, or null if it has another length or an element that is null or no number."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when((F.size(embedding) == dims) & fine, F.col(embedding))


def vector_totals(df: DataFrame, by: list[str], embedding: str, dims: int) -> DataFrame:
    """Sum of usable vectors and row count per key, combined before the shuffle."""
    rows = unpacked(df.select(*by, embedding), embedding)
    totals = rows.withColumn(embedding, usable(embedding, dims)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), vector_sum(embedding, dims, "_total")
    )
    return totals.withColumn("_total", F.transform("_total", lambda v: F.coalesce(v, F.lit(0.0))))


def add_vectors(a: str, b: str):
    zero = F.transform(F.coalesce(a, b), lambda v: v * 0.0)
    return F.zip_with(F.coalesce(a, zero), F.coalesce(b, zero), lambda x, y: x + y)


def semantic_deviation(
    df: DataFrame,
    user: str = "user",
    order: tuple[str, ...] = ("ts", "seq"),
    embedding: str = "embedding",
    dims: int | None = None,
    prior: DataFrame | None = None,
    rows_per_task: int = VECTOR_ROWS_PER_TASK,
    max_window_dims: int = MAX_WINDOW_DIMS,
    keep: tuple[str, ...] | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add ``semantic_deviation`` to the columns of ``keep``, by default to all.

    Leave the vector out of ``keep`` where it is not needed afterwards: it is by far
    the widest column, and it then makes the way to the Python workers only once.

    One shuffle on the user and one sort, in which a row carries its vector once, as it came. A user above ``rows_per_task`` is cut into
    time slots; a slot starts from the total of the earlier ones. Users are counted on ``df``, unless the caller knows that
    none has more than ``largest`` rows, which saves making ``df`` twice. ``prior`` holds
    ``user, _rows, _total`` of history before ``df``, as the streaming form keeps it.
    A vector that is null, of another length, or holds a null or NaN gets null and adds
    nothing to the history. Packed vectors (``functions.vectors``) stay packed.
    """
    dims = dims or vector_dims(df, embedding)
    keys = [Key(c) for c in order]
    slotted, slots = ordered_slots(df, [user], keys, rows_per_task, largest)
    starts = _slot_starts(slotted, user, slots, embedding, dims) if slots else None
    if prior is not None:
        base = prior.select(user, "_rows", "_total")
        starts = _after_prior(starts, base, user, slots) if slots else base
    columns = list(keep or df.columns)
    if starts is not None:
        slotted = slotted.join(starts, [user, *slots], "left")
    else:
        slotted = slotted.withColumns({
            "_rows": F.lit(None).cast("bigint"), "_total": F.lit(None).cast("array<double>"),
        })
    method = _by_window if dims <= max_window_dims and not is_packed(df, embedding) else _by_sorted_pass
    needed = dict.fromkeys([*columns, user, *order, *slots, embedding, "_rows", "_total"])
    scored = method(slotted.select(*needed), [user, *slots], keys, embedding, dims, columns)
    return scored.select(*columns, "semantic_deviation")


def _slot_starts(df: DataFrame, user: str, slots: list[str], embedding: str, dims: int) -> DataFrame:
    """For every slot of a user that was cut, the total of the user's earlier slots."""
    totals = vector_totals(df.filter(F.col(slots[0]) > 0), [user, *slots], embedding, dims)
    before = Window.partitionBy(user).orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    parts = [F.coalesce(F.sum(F.col("_total")[i]).over(before), F.lit(0.0)) for i in range(dims)]
    rows = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    return totals.select(user, *slots, rows.alias("_rows"), F.array(*parts).alias("_total"))


def _after_prior(starts: DataFrame, prior: DataFrame, user: str, slots: list[str]) -> DataFrame:
    """Starts of the cut users moved on by their history, and the history of the others.

    Users that were not cut have slot 0, so one join on user and slots finds either,
    and the rows of a busy user stay apart.
    """
    cut = starts.withColumnsRenamed({"_rows": "_r", "_total": "_t"}).join(prior, user, "left")
    cut = cut.select(
        user, *slots, (F.col("_r") + F.coalesce("_rows", F.lit(0))).alias("_rows"),
        add_vectors("_t", "_total").alias("_total"),
    )
    return cut.unionByName(prior.withColumns({s: F.lit(0) for s in slots}))


def _by_window(
    df: DataFrame, by: list[str], keys: list[Key], embedding: str, dims: int, columns: list[str]
) -> DataFrame:
    before = (
        Window.partitionBy(*by).orderBy(*[k.order(df) for k in keys])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn("_usable", usable(embedding, dims))
    parts = {f"_e{i}": F.col("_usable")[i].cast("double") for i in range(dims)}
    sums = {f"_s{i}": F.sum(f"_e{i}").over(before) for i in range(dims)}
    summed = df.withColumns(parts).withColumns({**sums, "_n": F.count(F.lit(1)).over(before)})

    started = "_total" in df.columns

    def total(i: int):
        own = F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
        return own + F.coalesce(F.col("_total")[i], F.lit(0.0)) if started else own

    # Balanced sums keep the expression tree shallow for the code generator.
    full = summed.withColumns({f"_h{i}": total(i) for i in range(dims)})
    inner = _sum([F.col(f"_e{i}") * F.col(f"_h{i}") for i in range(dims)])
    own = F.sqrt(_sum([F.col(f"_e{i}") * F.col(f"_e{i}") for i in range(dims)]))
    past = F.sqrt(_sum([F.col(f"_h{i}") * F.col(f"_h{i}") for i in range(dims)]))
    seen = F.col("_n") + F.coalesce("_rows", F.lit(0)) if started else F.col("_n")
    distance = F.lit(1.0) - F.try_divide(inner, own * past)
    return full.select(*columns, F.when(seen > 0, distance).alias("semantic_deviation"))


def _sum(terms: list):
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2:]
    return terms[0]


def _by_sorted_pass(
    df: DataFrame, by: list[str], keys: list[Key], embedding: str, dims: int, columns: list[str]
) -> DataFrame:
    """Each task reads its sorted rows batch by batch and carries one running sum.

    The window that marks the first row of a group also gives the shuffle and the sort.
    """
    group = Window.partitionBy(*by).orderBy(*[k.order(df) for k in keys])
    first = F.row_number().over(group) == 1
    started = "_total" in df.columns
    arranged = df.withColumn("_first", first)
    inputs = [*dict.fromkeys([*columns, embedding]), "_first"]
    if started:
        # Only a first row brings its start, and an absent one is an empty list: a
        # column of null lists made the whole pass three times slower.
        none = F.array().cast("array<double>")
        begins = F.col("_first") & F.col("_total").isNotNull()
        inputs.append(F.coalesce("_rows", F.lit(0)).cast("bigint").alias("_rows"))
        inputs.append(F.when(begins, F.col("_total")).otherwise(none).alias("_total"))
    arranged = arranged.select(*inputs)
    schema = extended(df.select(*columns).schema, "semantic_deviation double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(dims), 0
        for rows in batches:
            if not rows.num_rows:
                continue
            # a row without a usable vector adds nothing, and its norm of zero gives null
            vectors = usable_matrix(rows.column(embedding), dims)
            starts = np.flatnonzero(rows.column("_first").to_numpy(zero_copy_only=False))
            edges = [0, *starts[starts > 0].tolist(), len(vectors)]
            opening = set(starts.tolist())
            history = np.empty_like(vectors)
            known = np.empty(len(vectors), dtype=bool)
            for low, high in zip(edges[:-1], edges[1:]):
                if low in opening:
                    base = rows.column("_total")[low].as_py() if started else None
                    total = np.asarray(base) if base else np.zeros(dims)
                    seen = rows.column("_rows")[low].as_py() if started else 0
                part = vectors[low:high]
                history[low] = total
                np.cumsum(part[:-1], axis=0, out=history[low + 1:high])
                history[low + 1:high] += total
                known[low:high] = np.arange(seen, seen + len(part)) > 0
                total = total + part.sum(axis=0)
                seen += len(part)
            norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(history, axis=1)
            known &= norms > 0
            inner = np.einsum("ij,ij->i", vectors, history)
            deviation = 1.0 - np.divide(inner, norms, out=np.zeros_like(inner), where=known)
            yield with_column(rows.select(columns), "semantic_deviation", pa.array(deviation, mask=~known))

    return arranged.mapInArrow(run, schema)
