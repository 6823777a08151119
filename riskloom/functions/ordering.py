"""Exact ordering inside groups of any size.

A window over a group runs in one task, so a day or a user that holds a third of
the log would pin the job to that task. ``ordered_slots`` cuts every oversize group
into slots that follow the sort order; the window then runs per slot, and a small
table of slot counts carries the offset from slot to slot. Groups of normal size
keep a single slot and the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialize

ROWS_PER_TASK = 2_000_000
TEXT_PARTS = 4
LADDER = [i / 1024 for i in range(1, 1024)]
#: Accuracy of the quantile sketches: ranks are off by one part in so many.
ACCURACY = 10_000
#: Groups of more rows are narrowed by a sketch before they are shuffled.
BOUND_ROWS = 1_000


@dataclass(frozen=True)
class Key:
    """One sort key: a column name and its direction."""

    name: str
    descending: bool = False

    def value(self, df: DataFrame) -> Column:
        """The column to sort by. A number that is none sorts like a null one, however large its group."""
        col = F.col(self.name)
        floating = isinstance(df.schema[self.name].dataType, (T.DoubleType, T.FloatType))
        return F.when(~F.isnan(col), col) if floating else col

    def order(self, df: DataFrame) -> Column:
        return self.value(df).desc() if self.descending else self.value(df).asc()


def sort_numbers(df: DataFrame, key: Key) -> list[Column]:
    """Doubles whose lexicographic order follows the key's sort order.

    A long is split so that each part is exact in a double; a text gives the numbers
    of its first bytes, six at a time.
    """
    dtype = df.schema[key.name].dataType
    col = key.value(df)
    if isinstance(dtype, T.StringType):
        data = col.cast("binary")
        heads = [F.rpad(F.hex(F.substring(data, 1 + 6 * i, 6)), 12, "0") for i in range(TEXT_PARTS)]
        values = [F.conv(h, 16, 10).cast("double") for h in heads]
    elif isinstance(dtype, T.TimestampNTZType):
        values = [F.unix_micros(col.cast("timestamp")).cast("double")]
    elif isinstance(dtype, T.TimestampType):
        values = [F.unix_micros(col).cast("double")]
    elif isinstance(dtype, T.DateType):
        values = [F.unix_date(col).cast("double")]
    elif isinstance(dtype, T.LongType):
        values = [F.shiftright(col, 20).cast("double"), col.bitwiseAND(F.lit((1 << 20) - 1)).cast("double")]
    else:
        values = [col.cast("double")]
    values = [F.coalesce(v, F.lit(float("-inf"))) for v in values]
    return [-v for v in values] if key.descending else values


def ordered_slots(
    df: DataFrame,
    by: list[str],
    keys: list[Key],
    rows_per_task: int = ROWS_PER_TASK,
    largest: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add slot columns so that no ``(by, slots)`` group is oversize.

    Cuts are quantiles of the first key. A cut value is a slot of its own (an odd
    number) and so is each range between cuts (an even one); a value so common that
    it is oversize alone is always a cut, and the next key cuts it again. Groups that
    were not cut have slot 0, the slots of a cut group start at 2. Returns the frame
    and the slot columns, none when no group is oversize. The cuts are written
    before use, so a retried task puts a row into the same slot. Their number is
    bounded by ``rows / rows_per_task``, which is why they may be broadcast.
    ``largest`` is the size of the greatest group where the caller has counted already.
    """
    slots: list[str] = []
    levels = [(key, part, part == 0) for key in keys for part in range(len(sort_numbers(df, key)))]
    for level, (key, part, opens) in enumerate(levels):
        group = by + slots
        splittable = F.col("_n") > rows_per_task
        counts = [F.count(F.lit(1)).alias("_n")]
        if level:
            splittable &= F.col(slots[-1]) % 2 == 1
        if level and opens:
            # The next key may order only rows that agree on the one before.
            before = levels[level - 1][0].value(df)
            alike = F.count(before).isin(0, F.count(F.lit(1))) & F.min(before).eqNullSafe(F.max(before))
            counts.append(alike.alias("_one"))
            splittable &= F.col("_one")
        elif largest is not None and largest <= rows_per_task:
            break
        sizes = df.groupBy(*group).agg(*counts).filter(splittable).select(*group, "_n")
        if sizes.isEmpty():
            break
        big = materialize(sizes, "oversize-groups")
        number = sort_numbers(df, key)[part]
        keyed = df.select(*group, number.alias("_k"))
        on = [keyed[g].eqNullSafe(big[g]) for g in group]
        ladder = (
            keyed.join(F.broadcast(big), on)
            .groupBy(*[big[g] for g in group], big["_n"])
            .agg(F.percentile_approx("_k", LADDER, ACCURACY).alias("_q"))
        )
        step = F.greatest(F.lit(1), F.floor(F.lit(len(LADDER) + 1) * rows_per_task / F.col("_n")))
        cuts = ladder.select(
            *[F.col(g).alias(f"_c_{g}") for g in group],
            F.array_distinct(F.filter("_q", lambda v, i: (i + 1) % step == 0)).alias("_cuts"),
        )
        cuts = materialize(cuts, "slot-cuts")
        slot = f"_slot{level}"
        on = [F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in group]
        below = F.size(F.filter("_cuts", lambda v: v < F.col("_k"))) * 2
        exact = F.array_contains("_cuts", F.col("_k")).cast("int")
        df = (
            df.withColumn("_k", number)
            .join(F.broadcast(cuts), on, "left")
            .withColumn(slot, F.coalesce(below + exact + 2, F.lit(0)))
            .drop("_k", "_cuts", *[f"_c_{g}" for g in group])
        )
        slots.append(slot)
    return df, slots


def slot_offsets(df: DataFrame, by: list[str], slots: list[str]) -> DataFrame:
    """Rows per slot and rows in all earlier slots of the same group."""
    counts = df.groupBy(*by, *slots).agg(F.count(F.lit(1)).alias("_slot_rows"))
    before = Window.partitionBy(*by).orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_slot_rows").over(before), F.lit(0)))


def candidates(df: DataFrame, by: list[str], key: Key, quotas: DataFrame) -> tuple[DataFrame, int]:
    """The rows that can be among the first ``quota`` of their group, and the size of the largest group of them.

    A mergeable quantile sketch of the first sort key, combined in every map task, bounds the key of the
    quota-th row. Only rows within the bound are written, before anything is shuffled: per group about the quota, two
    thousandths of its rows, and ties at the bound. If the sketch should have been too tight
    for some group, the count shows it and all rows are taken.
    """
    number = sort_numbers(df, key)[0]
    sketch = df.select(*by, number.alias("_k")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_k", LADDER, ACCURACY).alias("_ladder"))
    step = F.ceil((F.col("quota") / F.col("_n") + F.lit(2 / ACCURACY)) * (len(LADDER) + 1)).cast("int")
    bounds = sketch.join(quotas.select(*by, "quota"), by).select(
        *by, F.least("quota", "_n").alias("_least"), F.get("_ladder", step - 1).alias("_bound"))
    bounds = materialize(bounds, "selection-bounds")
    near = df.join(bounds, by).filter(F.col("_bound").isNull() | (number <= F.col("_bound"))).select(*df.columns)
    near = materialize(near, "selection-candidates")
    found = near.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    state = bounds.join(found, by, "left").agg(
        F.max("_n").alias("largest"), F.coalesce(F.max(F.coalesce("_n", F.lit(0)) < F.col("_least")), F.lit(False)).alias("short")).first()
    if state["short"]:
        return df, sketch.agg(F.max("_n")).first()[0]
    return near, state["largest"] or 0


def take_in_order(
    df: DataFrame,
    by: list[str],
    keys: list[Key],
    quotas: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
    rank: str | None = None,
    largest: int | None = None,
    narrow: bool = True,
) -> DataFrame:
    """The first ``quota`` rows of every group in key order.

    ``quotas`` has one row per group with its ``quota``; groups without a row are
    dropped. Groups of more than ``BOUND_ROWS`` rows are narrowed first, see ``candidates``, unless
    the caller has done so (``narrow``). Slots that lie wholly before the quota pass without ranking, slots
    wholly behind it are dropped before any shuffle, and only the slot that holds
    the edge is sorted. ``rank`` names an output column for the exact position;
    asking for it ranks every kept slot.
    """
    wanted = rank or "_rank"
    if narrow and (largest is None or largest > BOUND_ROWS):
        df, largest = candidates(df, by, keys[0], quotas)
    slotted, slots = ordered_slots(df, by, keys, rows_per_task, largest)
    window = Window.partitionBy(*by, *slots).orderBy(*[k.order(df) for k in keys])
    if not slots:
        kept = slotted.withColumn(wanted, F.row_number().over(window).cast("bigint"))
        kept = kept.join(quotas, by).filter(F.col(wanted) <= F.col("quota")).drop("quota")
        return kept if rank else kept.drop(wanted)
    edges = materialize(
        slot_offsets(slotted, by, slots).join(quotas, by)
        .filter(F.col("_before") < F.col("quota")),
        "slot-edges",
    )
    near = slotted.join(edges, by + slots)
    position = (F.col("_before") + F.row_number().over(window)).cast("bigint")
    drop = ["_slot_rows", "_before", "quota", *slots]
    if rank:
        return near.withColumn(rank, position).filter(F.col(rank) <= F.col("quota")).drop(*drop)
    whole = F.col("_before") + F.col("_slot_rows") <= F.col("quota")
    inside = near.filter(whole).drop(*drop)
    edge = near.filter(~whole).withColumn("_rank", position)
    edge = edge.filter(F.col("_rank") <= F.col("quota")).drop(*drop, "_rank")
    return inside.unionByName(edge)
