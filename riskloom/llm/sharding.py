"""Balanced label propagation: linked documents move to their neighbours' shard under quotas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialize

SHARDS, ROUNDS = 8, 6
#: How far over the mean a shard may grow while documents move.
SLACK = 0.02
#: Classes of gain and slices of the hash by which moves are admitted, so quotas need a bounded table only.
GAINS, SLICES = 4, 64
#: Slices of the hash that the last evening-out can move.
FINE = 4096
#: Neighbours are parted only while a shard is further from the mean than this part of it.
EVEN = 0.001
#: Rows in one stretch of slots.
STRETCH = 50_000


def admitted(wishes: list[dict], sizes: dict[int, int], room: int) -> list[tuple[int, int, int, int]]:
    """Which (from, to, gain, slice) may move: the largest gains first, while the target has room.

    A shard's room grows with what leaves it, so passes go on until nothing more fits.
    """
    left, chosen, moved = sorted(wishes, key=lambda w: (-w["gain"], w["slice"], w["from"], w["to"])), [], True
    while moved:
        moved, rest = False, []
        for w in left:
            if sizes[w["to"]] + w["bytes"] <= room:
                sizes[w["to"]] += w["bytes"]
                sizes[w["from"]] -= w["bytes"]
                chosen.append((w["from"], w["to"], w["gain"], w["slice"]))
                moved = True
            else:
                rest.append(w)
        left = rest
    return chosen


def shard_sizes(labels: DataFrame, shards: int) -> dict[int, int]:
    sizes = dict.fromkeys(range(shards), 0)
    sizes.update({r["shard"]: r["bytes"] for r in labels.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()})
    return sizes


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, size, shard) for ``nodes`` (node, size), given ``links`` (node, link).

    Nodes that name one ``link`` are neighbours through it; a node may have several. A
    round tells each link what part of its nodes each shard holds, each node the sum over
    its links, and a node wishes to go where that is largest
    (itself included; ties go round by the link, so that all its nodes agree). Wishes are
    admitted by gain under each shard's quota. At the end, nodes without neighbours even
    out what is left, then others.
    """
    shared = links.distinct().groupBy("link").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    links = materialize(links.distinct().join(shared, "link").select("node", "link", "members"), "links")
    linked = links.select("node").distinct().withColumn("linked", F.lit(1))
    spread = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1 << 20)).cast("int")
    labels = nodes.join(linked, "node", "left").select(
        "node", "size", F.coalesce("linked", F.lit(0)).alias("linked"), spread.alias("slot"),
        F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shards)).cast("int").alias("shard"))
    labels = materialize(labels, "labels")
    total = sum(shard_sizes(labels, shards).values())
    room = math.ceil(total / shards * (1 + SLACK))
    for _ in range(rounds):
        # nodes without neighbours can fill up any shard later, so only linked ones take up room
        sizes = shard_sizes(labels.filter("linked = 1"), shards)
        votes = links.join(labels.select("node", "shard"), "node").groupBy("link", "members", "shard").agg(
            F.count(F.lit(1)).alias("n"))
        spreads = votes.groupBy("link").agg(
            F.collect_list(F.struct("shard", (F.col("n") / F.col("members")).alias("part"))).alias("all"))
        # one entry per shard at most, so the message to a node is small however large the link
        told = links.join(spreads, "link").select("node", "link", F.inline("all"))
        sums = told.groupBy("node", "shard").agg(F.round(F.sum("part"), 9).alias("part"))
        firsts = links.groupBy("node").agg(F.min("link").alias("first"))
        turn = F.pmod(F.col("there") - F.pmod(F.xxhash64("first"), F.lit(shards)), F.lit(shards))
        seen = sums.withColumnRenamed("shard", "there").join(labels, "node").join(firsts, "node")
        best = seen.groupBy("node", "size", "shard", "slot").agg(
            F.max(F.struct("part", (-turn).alias("turn"), "there")).alias("best"),
            F.max(F.when(F.col("there") == F.col("shard"), F.col("part"))).alias("now"))
        wishes = best.filter("best.there <> shard").select(
            "node", "size", F.col("shard").alias("from"), F.col("best.there").alias("to"),
            F.least(F.lit(GAINS - 1), F.floor((F.col("best.part") - F.col("now")) * GAINS)).cast("int").alias("gain"),
            F.pmod(F.col("slot"), F.lit(SLICES)).alias("slice"))
        wishes = materialize(wishes, "wishes")
        table = [r.asDict() for r in wishes.groupBy("from", "to", "gain", "slice").agg(F.sum("size").alias("bytes")).collect()]
        if not table:
            break
        chosen = admitted(table, sizes, room)
        if not chosen:
            break
        allowed = nodes.sparkSession.createDataFrame(chosen, "from int, to int, gain int, slice int")
        moves = wishes.join(F.broadcast(allowed), ["from", "to", "gain", "slice"]).select("node", "to")
        labels = materialize(labels.join(moves, "node", "left").select(
            "node", "size", "linked", "slot", F.coalesce("to", "shard").alias("shard")), "labels")
    return evened(labels, shards).select("node", "size", "shard")


def evened(labels: DataFrame, shards: int) -> DataFrame:
    """Move slices of the hash from shards above the mean to those below, free nodes first."""
    fine = F.pmod(F.col("slot"), F.lit(FINE))
    cells = labels.groupBy("shard", "linked", fine.alias("cell")).agg(F.sum("size").alias("bytes")).collect()
    sizes = dict.fromkeys(range(shards), 0)
    for c in cells:
        sizes[c["shard"]] += c["bytes"]
    mean, moves = sum(sizes.values()) / shards, []
    for c in sorted(cells, key=lambda c: (c["linked"], -c["bytes"], c["shard"], c["cell"])):
        to = min(range(shards), key=lambda s: (sizes[s], s))
        if c["linked"] and max(abs(b - mean) for b in sizes.values()) <= EVEN * mean:
            break  # even enough not to part neighbours for it
        # a move helps only if it brings both shards nearer to the mean
        if sizes[c["shard"]] - mean >= c["bytes"] / 2 and mean - sizes[to] >= c["bytes"] / 2:
            sizes[c["shard"]] -= c["bytes"]
            sizes[to] += c["bytes"]
            moves.append((c["shard"], c["linked"], c["cell"], to))
    if not moves:
        return labels
    table = labels.sparkSession.createDataFrame(moves, "shard int, linked int, cell int, to int")
    return labels.withColumn("cell", fine).join(F.broadcast(table), ["shard", "linked", "cell"], "left").withColumn(
        "shard", F.coalesce("to", "shard")).drop("cell", "to")


def with_slots(rows: DataFrame, key: list[str]) -> DataFrame:
    """Number each shard's rows from 0 without a gap, in stretches dealt by a hash of ``key``."""
    from pyspark.sql import Window

    stretches = max(1, math.ceil(rows.count() / STRETCH))
    dealt = rows.withColumn("__stretch", F.pmod(F.xxhash64(*key), F.lit(stretches)))
    counts = dealt.groupBy("shard", "__stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__stretch").orderBy(*key)
    # the number of stretches grows with the rows: Catalyst broadcasts them while they are few
    return dealt.join(starts, ["shard", "__stretch"]).withColumn(
        "slot", F.col("__start") + F.row_number().over(inside) - 1).drop("__stretch", "__start")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near equal bytes.

    Documents of equal text are linked and kept together as far as the quotas allow. The
    law is ``bytes``. Size is the text's UTF-8 bytes plus 1, the CRC that of the text; a
    null text counts as empty and is linked to empty ones. Repeated rows and rows without
    an id are placed one by one. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    # rows get a number of their own once they are written, so equal ones stay apart
    rows = materialize(materialize(rows, "rows").withColumn("node", F.monotonically_increasing_id()), "numbered")
    link = F.xxhash64("hash", "text_crc32", "size")
    placed = propagate(rows.select("node", "size"), rows.select("node", link.alias("link")), shards)
    done = materialize(rows.select("node", "doc_id", "text_crc32").join(placed, "node"), "placed")
    return with_slots(done, ["doc_id", "node"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_sharding": (op8_sharding, None)}
