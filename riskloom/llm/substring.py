"""Substring deduplication with a compressed FM-index per shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import repeats
from riskloom.llm.fm_index import FMIndex, matching_windows
from riskloom.llm.windows import covered

#: Words in a window, and in the anchors that deal windows to shards.
WINDOW, ANCHOR = 50, 16


def search_shard(table: pa.Table, rule: repeats.Rule) -> pa.Table:
    """Index one shard's contents and stream them over it.

    A content's words are numbered within the shard, laid end to end with a closing 0,
    and indexed. The matching statistics of each content give, for each of its windows,
    the interval of all equal windows; its smallest document is read off the interval.
    Windows that can't be earlier elsewhere are left out.
    """
    n = table.column("n").to_numpy()
    first, times = table.column("first").to_numpy(), table.column("times").to_numpy()
    bodies = table.column("body").to_pylist()
    lengths = n.astype(np.int64) + rule.window - 1
    words, ids = np.unique(np.frombuffer(b"".join(bodies), np.uint64), return_inverse=True)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    place = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
    text[place] = ids + 1
    index = FMIndex(text, len(words) + 1, rule.window)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)[index.rows]
    new = index.runs(rule.window)
    least = np.minimum.reduceat(first[owner], np.flatnonzero(new))
    run = np.cumsum(new) - 1
    offsets = np.concatenate(([0], np.cumsum(n)))
    found = np.empty(int(offsets[-1]), np.int64)
    for who, window, low, _ in matching_windows(index, text, begins, lengths, rule.window):
        found[offsets[who] + window] = least[run[low]]
    of = np.repeat(np.arange(len(n)), n)
    useful = (found < first[of]) | (times[of] > 1)
    change = np.ones(len(found), bool)
    change[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1]) | (useful[1:] != useful[:-1])
    heads = np.flatnonzero(change)
    tails = np.append(heads[1:], len(found))
    heads, tails = heads[useful[heads]], tails[useful[heads]]
    return stretches(table, of[heads], heads - offsets[of[heads]], tails - offsets[of[heads]], found[heads])


def stretches(table: pa.Table, row, starts, ends, first) -> pa.Table:
    """One row per content that has stretches (given in row order)."""
    rows, counts = np.unique(row, return_counts=True)
    edges = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    take = pa.array(rows)

    def lists(values, kind):
        return pa.ListArray.from_arrays(edges, pa.array(values, kind))

    return pa.table({
        "anchor": table.column("anchor").combine_chunks().take(take),
        "content": table.column("content").combine_chunks().take(take),
        "starts": lists(starts, pa.int32()), "ends": lists(ends, pa.int32()), "first": lists(first, pa.int64())})


def search(bodies: DataFrame, rule: repeats.Rule) -> DataFrame:
    return bodies.groupBy("shard").applyInArrow(lambda t: search_shard(t, rule), repeats.SOLVED)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text, spans): the stretches of words that an earlier document holds too.

    A word is a run of bytes other than ASCII white space. ``spans`` lists half-open
    (from, to) word positions covered by windows of ``window`` words that also start in
    a document with a smaller id; they may overlap. A null text is empty; a document
    without an id removes nothing and loses nothing. Rows with one id, repeated or not,
    never act on each other. Other columns are ignored.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = repeats.repeated_spans(rows, repeats.Rule("words", window, min(anchor, window)), search, earlier=True)
    return repeats.with_spans(rows, spans).select("doc_id", "text", "spans")


def digest(batches):
    """n_words, n_removed and the hash of what is left, for each text and its spans."""
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(i) for i in range(3))):
            words = text.as_py().encode().split()
            kept, spans = words, spans.as_py()
            if spans:
                gone = covered(len(words), [s["from"] for s in spans], [s["to"] for s in spans])
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            out.append((doc.as_py(), len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents),
s as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) h
      from (select doc_id, words, unnest(range(1, len(words) - 48)) i from w where len(words) >= 50)),
f as (select h, min(doc_id) d from s group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) p from s join f using (h) where f.d < s.doc_id),
k as (select w.doc_id, p, words[p] word from (select doc_id, words, unnest(range(1, len(words) + 1)) p from w) w
      where not exists (select 1 from gone g where g.doc_id = w.doc_id and g.p = w.p)),
a as (select doc_id, count(*) n, string_agg(word, ' ' order by p) t from k group by doc_id)
select w.doc_id, cast(len(words) as bigint) n_words, cast(len(words) - coalesce(a.n, 0) as bigint) n_removed,
       sha256(coalesce(a.t, '')) kept_sha256
from w left join a using (doc_id)
"""
QUERIES = {"op2_substring_dedup": (op2_substring_dedup, SQL)}
