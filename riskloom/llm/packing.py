"""Sum-of-squares packing of documents into sequences of fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.text_tokens import WordTokens
from riskloom.llm.worker import kept
from riskloom.session import materialize

SIZE = 2048
#: Pieces that one task packs, about; leftovers of a group are a few sequences at most.
GROUP = 32_000
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def piece_table(docs: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str | None) -> DataFrame:
    """One row per piece of at most ``size`` ids; every document ends with id 0."""

    def cut(batches):
        path = vocabulary or vocabulary_path()
        tokens = kept(f"tokens {path}", lambda: WordTokens(path))
        for batch in batches:
            raws = [ids + b"\0\0\0\0" for ids in tokens.many(batch.column(1).fill_null("").to_pylist())]
            sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
            counts = -(-sizes // size)
            rows = np.repeat(np.arange(len(raws)), counts)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * size
            length = np.minimum(sizes[rows] - start, size)
            crc = [zlib.crc32(memoryview(raws[r])[4 * s:4 * (s + n)]) for r, s, n in zip(rows.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the order given.

    ``open_bins[g]`` counts the open bins with ``g`` places left. An item goes where the
    sum of the squared counts becomes smallest, counting full bins as closed; of equal
    places the tightest open bin wins, a new bin comes last.
    """
    open_bins = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gap = 0
        if s < size:
            before = open_bins[s:size]
            change = 2 * (open_bins[:size - s] - before) + 2
            change[0] = 1 - 2 * before[0]
            change[before == 0] = never
            best = int(change.argmin())
            if before[best] and change[best] <= 2 * open_bins[size - s] + 1:
                gap = s + best
        if gap:
            where = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            where, gap, made = made, size, made + 1
        bins[i], offsets[i] = where, size - gap
        if gap > s:
            open_bins[gap - s] += 1
            stacks[gap - s].append(where)
    return bins, offsets


def pack_group(size: int):
    def pack(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("piece", "length", "ids_crc32")}
        ids = table.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        # in the order of a hash, but the shortest fifth last and falling: it fills the gaps that are left
        small = cols["length"] < np.quantile(cols["length"], 0.2)
        order = np.lexsort((cols["piece"], ids, cols["ids_crc32"], np.where(small, -cols["length"], 0), small))
        bins, offsets = sum_of_squares(cols["length"][order], size)
        group = table.column("pack_group")[0].as_py()
        table = table.take(pa.array(order))
        table = table.append_column("sequence_id", pa.array((group << 32) + bins))
        return table.append_column("offset", pa.array(offsets)).drop_columns(["pack_group"])

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         vocabulary: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    A document is its ids and a closing 0, so a null or empty text is one id long. Only
    longer ones are cut, into pieces of ``size``. Each group of about ``GROUP`` pieces is
    dealt by a hash, thus alike in its mix of lengths, and packed by itself: a group's
    state is one count per gap, its open bins and its rows, whatever the corpus. Repeated
    rows are packed as often as they come; a null id is kept. Other columns are ignored.
    """
    pieces = materialize(piece_table(docs, id_col, text_col, size, vocabulary), "pieces")
    groups = max(1, round(pieces.count() / GROUP))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(pack_group(size), PIECES + ", sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_packing": (op1_packing, None)}
