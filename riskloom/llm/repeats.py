"""Removing text that stands elsewhere in the corpus, over windows of words or bytes.

The flow is the same for both units; only the way in which one shard is solved differs.

1. Each document's windows are cut into segments by anchor (:mod:`windows`). Anchors are
   counted over the corpus; one that stands once holds nothing that is repeated.
2. A bit filter, sized by the number of repeated anchors, names them to a second scan,
   which lists the candidate segments with a hash of their content. False hits fall out
   again when the listed segments are counted exactly. Anchors too many for a filter meet
   the segments in a join.
3. Equal contents collapse to one representative, so a text copied a million times is
   looked at once. Representatives go, by anchor, to shards of bounded size, and the
   shard's index says which windows of each content are repeated.
4. The answers return to all occurrences of a content, and to the documents.

An anchor that stands at more than ``HOT`` places of its distinct contents (in a ruled
line it stands hundreds of times), or whose contents fill ``HOT_SHARDS`` shards, would
outgrow a task. Its windows are counted one by one instead, by content, with partial sums
before the exchange: exact, and without a group that grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.windows import PLACE, WordHashes, gram_hashes, segments
from riskloom.session import materialize

#: Places of one anchor, and shards filled by it, that a task takes; above it windows are counted singly.
HOT, HOT_SHARDS = 100_000, 4
#: Tokens that one shard's representatives hold, about, and places of their anchors.
SHARD_TOKENS = {"bytes": 8_000_000, "words": 1_000_000}
SHARD_PLACES = 100_000
#: Bits of the filter per repeated anchor, and the largest filter (128 MB) as a power of two.
ANCHOR_BITS, FILTER_BITS = 32, 30
#: Tokens worked on at once.
CHUNK = 500_000

#: Stands for "no document": rows without an id hold nothing earlier than others.
NO_ID = (1 << 63) - 1

BYTE_UNITS = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)


@dataclass(frozen=True)
class Rule:
    """What counts as a window: ``unit`` is ``bytes`` or ``words``, ``k`` the anchor's length."""

    unit: str
    window: int
    k: int

    @property
    def width(self) -> int:
        """Bytes per token in a shipped content: words travel as 64-bit hashes."""
        return 1 if self.unit == "bytes" else 8


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, dkey, text): a null text is empty; ``dkey`` tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("dkey"), text.alias("text"))


def tokens_of(rule: Rule, text: bytes, known: WordHashes) -> np.ndarray:
    """The tokens as shipped: bytes, or 64-bit word hashes."""
    if rule.unit == "bytes":
        return np.frombuffer(text, np.uint8)
    return known.of(text.split())


def units_of(rule: Rule, tokens: np.ndarray) -> np.ndarray:
    return BYTE_UNITS[tokens] if rule.unit == "bytes" else tokens


def pieces(rule: Rule, texts: Iterator[tuple[int, bytes]], known: WordHashes):
    """Chunks of (row, offset, tokens) with about ``CHUNK`` tokens.

    A longer document is cut into pieces that overlap by one window less a token, so
    each window is whole in exactly one piece.
    """
    held, size = [], 0
    for row, text in texts:
        tokens = tokens_of(rule, text, known)
        for at in range(0, max(1, len(tokens) - rule.window + 1), CHUNK):
            part = tokens[at:at + CHUNK + rule.window - 1]
            if len(part) < rule.window:
                continue
            held.append((row, at, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def chunk_segments(rule: Rule, held):
    """(tokens, bounds, rows, offsets) of a chunk and its segments."""
    tokens = np.concatenate([part for _, _, part in held])
    bounds = np.concatenate(([0], np.cumsum([len(part) for _, _, part in held])))
    return tokens, bounds, segments(units_of(rule, tokens), bounds, rule.window, rule.k)


def encoded(column: pa.Array):
    for row, text in enumerate(column):
        yield row, (text.as_py() or "").encode()


def repeated_anchors(docs: DataFrame, rule: Rule) -> DataFrame:
    """(anchor) of all that stand in two segments or twice in one."""

    def count(batches):
        known = WordHashes()
        for batch in batches:
            for held in pieces(rule, encoded(batch.column(0)), known):
                _, _, (_, _, _, anchors, repeats) = chunk_segments(rule, held)
                found, place, times = np.unique(anchors, return_inverse=True, return_counts=True)
                many = times > 1
                many[place[repeats]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(many.astype(np.int32) + 1)], names=["anchor", "times"])

    counted = docs.select("text").mapInArrow(count, "anchor long, times int")
    return counted.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor")


def filter_bits(anchors: int) -> int | None:
    """The size of the filter as a power of two; None if no filter of the largest size will do."""
    bits = max(18, math.ceil(math.log2(max(1, anchors) * ANCHOR_BITS)))
    return bits if bits <= FILTER_BITS else None


def bit_filter(anchors: DataFrame, bits: int) -> bytes:
    """The anchors as a set of ``2 ** bits`` bits, built by partial ``or`` before it is sent."""
    place = [F.shiftrightunsigned(F.xxhash64("anchor", F.lit(i)), 64 - bits) for i in range(2)]
    words = (
        anchors.select(F.explode(F.array(*place)).alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        .groupBy(F.shiftright("w", 12).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("cells"))
        .select("block", F.transform("cells", lambda c: (c["w"] % 4096).cast("short")).alias("w"),
                F.transform("cells", lambda c: c["bits"]).alias("bits"))
    )
    table = np.zeros(1 << (bits - 6), np.int64)
    for row in words.toLocalIterator():
        table[row["block"] * 4096 + np.array(row["w"], np.int64)] = np.array(row["bits"], np.int64)
    return table.tobytes()


def in_filter(table: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether each anchor may be in the bit set; agrees with :func:`bit_filter`."""
    raw = np.ascontiguousarray(anchors)
    hit, unused = np.ones(len(raw), bool), 65 - (len(table) * 64).bit_length()
    for i in range(2):
        p = spark_hash_long(raw, i) >> np.uint64(unused)
        word = table[(p >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        hit &= (word >> (p & np.uint64(63))) & np.uint64(1) != 0
    return hit


def spark_hash_long(x: np.ndarray, extra: int) -> np.ndarray:
    """``xxhash64(long, int)`` of Spark, vectorised (XXH64 of one 8-byte and one 4-byte value)."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(v, r):
        return (v << np.uint64(r)) | (v >> np.uint64(64 - r))

    def last(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.full(len(x), 42, np.uint64) + p5 + np.uint64(8)
        h ^= turn(x.view(np.uint64) * p2, 31) * p1
        h = last(turn(h, 27) * p1 + p4)
        h = h + p5 + np.uint64(4)
        h ^= np.uint64(extra) * p1
        return last(turn(h, 23) * p2 + p3)


CANDIDATE = "anchor long, content long, doc_id long, dkey long, start long, n int, repeats boolean"


def candidates(docs: DataFrame, rule: Rule) -> DataFrame:
    """Segments whose anchor may be repeated, with a hash of their content."""
    many = materialize(repeated_anchors(docs, rule), "repeated-anchors")
    bits = filter_bits(many.count())
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(many, bits) if bits else None)

    def find(batches):
        known, table = WordHashes(), np.frombuffer(sent.value, np.int64) if sent.value else None
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            for held in pieces(rule, encoded(texts), known):
                tokens, bounds, (piece, at, n, anchors, repeats) = chunk_segments(rule, held)
                pick = np.arange(len(anchors)) if table is None else np.flatnonzero(in_filter(table, anchors.view(np.int64)))
                if not len(pick):
                    continue
                piece, at, n, anchors, repeats = piece[pick], at[pick], n[pick], anchors[pick], repeats[pick]
                raw, first = tokens.tobytes(), (bounds[piece] + at) * rule.width
                size = (n + rule.window - 1) * rule.width
                content = np.fromiter(
                    (xxhash.xxh64_intdigest(raw[a:a + s]) for a, s in zip(first.tolist(), size.tolist())),
                    np.uint64, len(pick))
                rows = np.array([r for r, _, _ in held])[piece]
                offset = np.array([o for _, o, _ in held])[piece]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors.view(np.int64)), pa.array(content.view(np.int64)), ids.take(take),
                    keys.take(take), pa.array(at + offset), pa.array(n.astype(np.int32)), pa.array(repeats)],
                    names=["anchor", "content", "doc_id", "dkey", "start", "n", "repeats"])

    found = docs.select("doc_id", "dkey", "text").mapInArrow(find, CANDIDATE)
    return found if bits else found.join(many, "anchor", "left_semi")


SHIPPED = "anchor long, content long, times long, first long, n int, body binary, places int"


def anchor_places(rule: Rule, tokens: np.ndarray, anchor: int) -> int:
    """At how many places of a content its anchor stands."""
    grams = gram_hashes(units_of(rule, tokens), rule.k) & ~PLACE
    return int((grams.view(np.int64) == anchor).sum())


def shipped(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """The wanted contents with their tokens, cut from the representatives' documents."""
    per_doc = wanted.groupBy("doc_id", "dkey").agg(
        F.collect_list(F.struct("anchor", "content", "times", "first", "start", "n", "repeats")).alias("cuts"))
    joined = docs.withColumnsRenamed({"doc_id": "d_id", "dkey": "d_key"})
    joined = joined.join(per_doc, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("dkey")))

    def cut(batches):
        known = WordHashes()
        for batch in batches:
            cuts = batch.column(1)
            owner = cuts.value_parent_indices().to_numpy()
            flat = cuts.flatten()
            cols = {f: flat.field(f) for f in ("anchor", "content", "times", "first", "n")}
            starts, counts = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            anchors, again = flat.field("anchor").to_numpy(), flat.field("repeats").to_numpy(zero_copy_only=False)
            edges, bodies, places = np.searchsorted(owner, np.arange(len(batch) + 1)), [], []
            for row, text in encoded(batch.column(0)):
                tokens = tokens_of(rule, text, known)
                for i in range(edges[row], edges[row + 1]):
                    body = tokens[starts[i]:starts[i] + counts[i] + rule.window - 1]
                    bodies.append(body.tobytes())
                    places.append(anchor_places(rule, body, anchors[i]) if again[i] else 1)
            yield pa.RecordBatch.from_arrays(
                [cols["anchor"], cols["content"], cols["times"], cols["first"], cols["n"], pa.array(bodies, pa.binary()),
                 pa.array(places, pa.int32())],
                names=["anchor", "content", "times", "first", "n", "body", "places"])

    return joined.select("text", "cuts").mapInArrow(cut, SHIPPED).dropDuplicates(["anchor", "content"])


SOLVED = "anchor long, content long, starts array<int>, ends array<int>, first array<long>"


def hot_windows(bodies: DataFrame, rule: Rule) -> DataFrame:
    """The exact way for crowded anchors: every window counted by its content.

    Equal windows of one content travel as one row, so a ruled line costs one row per content.
    A window that a great many contents share is left to the skew join of adaptive execution.
    """

    def spread(batches):
        size, step = rule.window * rule.width, rule.width
        for batch in batches:
            n, bodies = batch.column("n").to_pylist(), batch.column("body").to_pylist()
            for at in range(0, len(n), 256):
                row, hashes, places = [], [], []
                for i in range(at, min(at + 256, len(n))):
                    own: dict[bytes, list[int]] = {}
                    for w in range(n[i]):
                        own.setdefault(xxhash.xxh3_128_digest(bodies[i][w * step:w * step + size]), []).append(w)
                    row += [i] * len(own)
                    hashes += own
                    places += own.values()
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("anchor", "content", "times", "first")),
                     pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.binary())],
                    names=["anchor", "content", "times", "first", "places", "h"])

    def joined(batches):
        for batch in batches:
            windows = batch.column("w")
            owner, flat = windows.value_parent_indices().to_numpy(), windows.flatten()
            i, least = flat.field("i").to_numpy(), flat.field("least").to_numpy()
            new = np.ones(len(i), bool)
            new[1:] = (np.diff(owner) != 0) | (np.diff(i) != 1) | (np.diff(least) != 0)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(i)) - 1
            edges = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[heads], minlength=len(batch))))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor"), batch.column("content"),
                 *(pa.ListArray.from_arrays(edges, pa.array(v, t)) for v, t in (
                     (i[heads], pa.int32()), (i[tails] + 1, pa.int32()), (least[heads], pa.int64())))],
                names=["anchor", "content", "starts", "ends", "first"])

    rows = bodies.mapInArrow(spread, "anchor long, content long, times long, first long, places array<int>, h binary")
    rows = materialize(rows, "hot-windows")
    known = rows.groupBy("h").agg(F.sum(F.col("times") * F.size("places")).alias("all"), F.min("first").alias("least"))
    back = rows.join(known, "h").filter("all > 1").select("anchor", "content", "least", F.explode("places").alias("i"))
    lists = back.groupBy("anchor", "content").agg(F.sort_array(F.collect_list(F.struct("i", "least"))).alias("w"))
    return lists.mapInArrow(joined, SOLVED)


def repeated_spans(docs: DataFrame, rule: Rule, solve: Callable, earlier: bool) -> DataFrame:
    """(doc_id, dkey, spans) for documents with repeated windows.

    ``docs`` comes from :func:`keyed`. ``solve`` takes rows of ``SHIPPED`` with their
    ``shard`` and returns rows of ``SOLVED``: stretches of windows that are repeated,
    each with the smallest document that holds it.
    ``earlier`` keeps only windows that a smaller document id holds too; otherwise a
    window counts if it stands anywhere else. ``spans`` lists (start, end) in tokens.
    """
    found = materialize(candidates(docs, rule), "segments")
    contents = found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("times"), F.max("repeats").alias("repeats"),
        F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"),
        F.min(F.struct("doc_id", "dkey", "start", "n")).alias("place"))
    groups = contents.groupBy("anchor").agg(
        F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds"), F.max("repeats").alias("any"))
    groups = groups.filter("all > 1 or any")
    contents = contents.join(groups, "anchor").select(
        "anchor", "content", "times", "first", "kinds", "repeats", "place.*")
    contents = materialize(contents, "contents")
    if earlier:
        # a content without a copy and alone at its anchor matches nothing in another document
        wanted = contents.filter("kinds > 1 or times > 1")
    else:
        wanted = contents.filter("kinds > 1 or (repeats and times = 1)")
    cut = materialize(shipped(docs, wanted, rule), "bodies")
    body = SHARD_TOKENS[rule.unit] * rule.width
    heavy = (F.col("places") > HOT) | (F.col("size") > HOT_SHARDS * body)
    loads = materialize(cut.groupBy("anchor").agg(
        F.sum("places").alias("places"), F.sum(F.length("body")).alias("size")).withColumn("heavy", heavy), "anchor-loads")
    size, places = loads.filter("not heavy").agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("places"), F.lit(0))).first()
    shards = max(1, -(-size // body), -(-places // SHARD_PLACES))
    hot = loads.filter("heavy").select("anchor")
    crowded, normal = not hot.isEmpty(), cut.drop("places")
    if crowded:
        hot = materialize(hot, "hot-anchors")
        normal = normal.join(hot, "anchor", "left_anti")
    solved = solve(normal.withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(9)), F.lit(shards))), rule)
    if crowded:
        solved = solved.unionByName(hot_windows(cut.drop("places").join(hot, "anchor", "left_semi"), rule))
    if not earlier:
        whole = contents.filter("times > 1").select("anchor", "content", F.array(F.lit(0)).alias("starts"),
                                                    F.array("n").alias("ends"), F.array("first").alias("first"))
        # copied contents are repeated in full, whatever their neighbours
        solved = solved.join(whole, ["anchor", "content"], "left_anti").unionByName(whole)
    solved = materialize(solved, "solved")
    parts = found.join(solved, ["anchor", "content"]).select(
        "doc_id", "dkey", "start", F.explode(F.arrays_zip("starts", "ends", "first")).alias("s"))
    if earlier:
        parts = parts.filter(F.col("s.first") < F.col("doc_id"))
    parts = parts.select("doc_id", "dkey", (F.col("start") + F.col("s.starts")).alias("from"),
                         (F.col("start") + F.col("s.ends") + (rule.window - 1)).alias("to")).distinct()
    return parts.groupBy("doc_id", "dkey").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document row with its spans (null where there are none)."""
    right = spans.withColumnsRenamed({"doc_id": "s_id", "dkey": "s_key"})
    return docs.join(right, docs["doc_id"].eqNullSafe(right["s_id"]) & (docs["dkey"] == right["s_key"]), "left").drop("s_id", "s_key")
