"""Suffix-array deduplication by a merge sort that exchanges front-coded runs.

Only suffixes that begin at a repeated anchor are sorted, and from each the bytes that
one window can reach. A map task sorts its suffixes, and what stands to their left read
backwards, and sends each shard a run in front coding: the length of the prefix shared
with the string before, and the rest. A shard merges its runs with a loser tree that
works on those lengths. A window around an anchor is then repeated if another one lies
in the same block of both orders, at the widths to the left and right that make it up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import repeats
from riskloom.llm.substring import stretches
from riskloom.llm.windows import PLACE, covered, gram_hashes, spans_of

#: Bytes in a window, and in the anchors that deal windows to shards.
WINDOW, ANCHOR = 200, 32
#: Bytes of contents sorted into one run at most.
RUN_BYTES = 4_000_000

RUN = ("shard long, anchor array<long>, content array<long>, times array<long>, n array<int>, place array<int>, "
       "order array<int>, right_lcp array<int>, right_rest array<int>, right binary, "
       "left_lcp array<int>, left_rest array<int>, left binary")


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no second look."""
    m = min(len(a), len(b))
    differ = int.from_bytes(a[known:m]) ^ int.from_bytes(b[known:m])
    return m - (differ.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[int], bytes]:
    """Shared prefix with the string before, length of the rest, and the rests."""
    lcps, rests, before = [], [], b""
    for s in strings:
        k = shared(before, s, 0)
        lcps.append(k)
        rests.append(s[k:])
        before = s
    return lcps, [len(r) for r in rests], b"".join(rests)


def decoded(lcps, sizes, blob: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for k, size in zip(lcps, sizes):
        before = before[:k] + blob[at:at + size]
        at += size
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs; returns (run, place) in order and each one's shared prefix with
    the one before.

    Every head carries the length of the prefix it shares with the last string that left
    the tree. Of two heads the one that shares more is the smaller, with no look at its
    bytes; only heads that share equally much are compared, from that byte on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [strings[0] if strings else None for strings, _ in runs] + [None] * (k - len(runs))
    lcp, place = [0] * k, [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two streams."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = lcp[a], lcp[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        if x == y:
            common = len(x)
            a, b = min(a, b), max(a, b)
        else:
            common = shared(x, y, p)
            if x[common:common + 1] > y[common:common + 1]:
                a, b = b, a
        lcp[b] = common
        return a, b

    winners = list(range(k))
    node = k
    while node > 1:
        node //= 2
        row = []
        for i in range(node):
            a, b = play(winners[2 * i], winners[2 * i + 1])
            row.append(a)
            loser[node + i] = b
        winners = row
    top = winners[0]
    order, common = [], []
    while heads[top] is not None:
        order.append((top, place[top]))
        common.append(lcp[top])
        place[top] += 1
        strings, lcps = runs[top]
        if place[top] < len(strings):
            heads[top], lcp[top] = strings[place[top]], lcps[place[top]]
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2
    return order, common


def anchor_places(bodies: list[bytes], anchors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, place) of every k-gram that is its content's anchor."""
    lengths = np.array([len(b) for b in bodies])
    begins = np.cumsum(lengths) - lengths
    grams = gram_hashes(repeats.BYTE_UNITS[np.frombuffer(b"".join(bodies), np.uint8)], k) & ~PLACE
    owner = np.repeat(np.arange(len(bodies)), lengths)[:len(grams)]
    hit = np.flatnonzero(grams == anchors.view(np.uint64)[owner])
    hit = hit[hit - begins[owner[hit]] + k <= lengths[owner[hit]]]
    return owner[hit], hit - begins[owner[hit]]


def make_runs(rule: repeats.Rule):
    """A map function from contents to sorted front-coded runs, one per shard and chunk."""

    def runs_of(table: pa.Table):
        bodies, shards = table.column("body").to_pylist(), table.column("shard").to_numpy()
        cols = {c: table.column(c).to_numpy() for c in ("anchor", "content", "times", "n")}
        owner, place = anchor_places(bodies, cols["anchor"], rule.k)
        rows = []
        for shard in np.unique(shards):
            pick = np.flatnonzero(shards[owner] == shard)
            who, at = owner[pick].tolist(), place[pick].tolist()
            right = [bodies[w][p:p + rule.window] for w, p in zip(who, at)]
            left = [bodies[w][max(0, p - rule.window + rule.k):p][::-1] for w, p in zip(who, at)]
            order = sorted(range(len(who)), key=right.__getitem__)
            back = sorted(range(len(who)), key=lambda i: left[order[i]])
            r_lcp, r_rest, r = front_coded([right[i] for i in order])
            l_lcp, l_rest, lt = front_coded([left[order[i]] for i in back])
            own = np.array([who[i] for i in order], np.int64)
            rows.append({
                "shard": int(shard), **{c: v[own] for c, v in cols.items()}, "place": [at[i] for i in order],
                "order": back, "right_lcp": r_lcp, "right_rest": r_rest, "right": r,
                "left_lcp": l_lcp, "left_rest": l_rest, "left": lt})
        kinds = {"shard": pa.int64(), "right": pa.binary(), "left": pa.binary(),
                 **{c: pa.list_(pa.int64()) for c in ("anchor", "content", "times")}}
        names = [c.split()[0] for c in RUN.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], kinds.get(c, pa.list_(pa.int32()))) for c in names], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= RUN_BYTES:
                yield runs_of(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield runs_of(pa.Table.from_batches(held))

    return run


def repeated_windows(table: pa.Table, rule: repeats.Rule) -> pa.Table:
    """Merge one shard's runs and mark the windows that occur twice."""
    rows = table.to_pylist()
    base = np.cumsum([0] + [len(r["place"]) for r in rows])
    cols = {c: np.concatenate([np.array(r[c], np.int64) for r in rows]) for c in ("anchor", "content", "times", "n", "place")}
    right = [decoded(r["right_lcp"], r["right_rest"], r["right"]) for r in rows]
    left = [decoded(r["left_lcp"], r["left_rest"], r["left"]) for r in rows]
    total = int(base[-1])
    r_order, r_lcp = merge_runs([(s, r["right_lcp"]) for s, r in zip(right, rows)])
    l_order, l_lcp = merge_runs([(s, r["left_lcp"]) for s, r in zip(left, rows)])
    r_size, l_size = np.empty(total, np.int64), np.empty(total, np.int64)
    r_at, l_at = np.empty(total, np.int64), np.empty(total, np.int64)
    for i, (run, p) in enumerate(r_order):
        e = base[run] + p
        r_at[i], r_size[e] = e, len(right[run][p])
    for i, (run, p) in enumerate(l_order):
        e = base[run] + rows[run]["order"][p]
        l_at[i], l_size[e] = e, len(left[run][p])
    r_lcp, l_lcp = np.array(r_lcp), np.array(l_lcp)
    of, first = content_numbers(cols["anchor"], cols["content"])
    n = cols["n"][first]
    offsets = np.concatenate(([0], np.cumsum(n)))
    twice = np.zeros(int(offsets[-1]), bool)
    r_block, l_block = np.empty(total, np.int64), np.empty(total, np.int64)
    for o in range(rule.window - rule.k + 1):
        r_block[r_at] = np.cumsum(r_lcp < rule.window - o)
        l_block[l_at] = np.cumsum(l_lcp < o) if o else 0
        fit = np.flatnonzero((l_size >= o) & (r_size >= rule.window - o) & (cols["place"] - o < n[of]))
        key = r_block[fit] * (total + 1) + l_block[fit]
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        again = np.zeros(len(fit), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        hit = fit[again]
        twice[offsets[of[hit]] + cols["place"][hit] - o] = True
    single = cols["times"][first] == 1
    twice &= np.repeat(single, n)
    owner = np.repeat(np.arange(len(n)), n)
    change = np.ones(len(twice), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (twice[1:] != twice[:-1])
    heads = np.flatnonzero(change)
    tails = np.append(heads[1:], len(twice))
    heads, tails = heads[twice[heads]], tails[twice[heads]]
    source = pa.table({"anchor": cols["anchor"][first], "content": cols["content"][first]})
    who = owner[heads]
    return stretches(source, who, heads - offsets[who], tails - offsets[who], np.zeros(len(heads), np.int64))


def content_numbers(anchor: np.ndarray, content: np.ndarray):
    """(number of each entry's content, an entry of each content)."""
    order = np.lexsort((content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def merge_sorted(bodies: DataFrame, rule: repeats.Rule) -> DataFrame:
    runs = bodies.mapInArrow(make_runs(rule), RUN)
    return runs.groupBy("shard").applyInArrow(lambda t: repeated_windows(t, rule), repeats.SOLVED)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text, spans): the stretches of bytes that stand anywhere else too.

    ``spans`` lists half-open (from, to) byte positions in the UTF-8 text, covered by
    strings of ``window`` bytes that start at another place in the corpus, in the same
    document or another; they may overlap. A null text is empty. Repeated rows are
    separate documents, so each is found in the other. Other columns are ignored.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = repeats.repeated_spans(rows, repeats.Rule("bytes", window, min(anchor, window)), merge_sorted, earlier=False)
    return repeats.with_spans(rows, spans).select("doc_id", "text", "spans")


def kept_bytes(text: bytes, spans) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed stretches."""
    if not spans:
        return text, 0
    gone = covered(len(text), [s["from"] for s in spans], [s["to"] for s in spans])
    starts, _ = spans_of(gone)
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), len(starts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with every text cut to what stands nowhere else; all columns and rows stay.

    A character goes only if all its bytes do, so texts stay valid. A null text stays null.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    rule = repeats.Rule("bytes", settings.get("window", WINDOW), settings.get("anchor", ANCHOR))
    spans = repeats.repeated_spans(rows, rule, merge_sorted, earlier=False).withColumnsRenamed(
        {"doc_id": "__span_id", "dkey": "__span_key", "spans": "__spans"})

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else kept_text(t, s) for t, s in zip(texts, found)])

    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__span_id")) & (key == F.col("__span_key"))
    joined = docs.join(spans, same, "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("__spans")))
    return joined.withColumn(text_col, text).select(docs.columns)


def kept_text(text: str, spans) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    gone = covered(len(raw), [s["from"] for s in spans], [s["to"] for s in spans])
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, starts)
    sizes = np.diff(np.append(starts, len(raw)))
    return raw[~np.repeat(whole, sizes)].tobytes().decode()


def digest(batches):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(i) for i in range(3))):
            raw = text.as_py().encode()
            kept, n_spans = kept_bytes(raw, spans.as_py())
            out.append((doc.as_py(), len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).mapInArrow(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
s as (select doc_id, i, hash(x[2 * i - 1:2 * i + 398]) k
      from (select doc_id, x, unnest(range(1, len(x) // 2 - 198)) i from h where len(x) >= 400)),
f as (select k from s group by k having count(*) > 1),
st as (select doc_id, i from s join f using (k)),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end new from st),
r as (select doc_id, sum(new) over (partition by doc_id order by i) run, i from g),
m as (select doc_id, run, min(i) a, max(i) + 200 b from r group by doc_id, run),
e as (select doc_id, a, b, lag(b, 1, 1) over (partition by doc_id order by a) prev,
             row_number() over (partition by doc_id order by a desc) last from m),
p as (select e.doc_id, count(*) n_spans, sum(b - a) gone,
             string_agg(x[2 * prev - 1:2 * a - 2], '' order by a) body,
             max(case when last = 1 then x[2 * b - 1:] else '' end) rest
      from e join h using (doc_id) group by e.doc_id)
select h.doc_id, cast(len(x) // 2 as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed,
       cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(body || rest, x))) kept_sha256
from h left join p using (doc_id)
"""
QUERIES = {"op9_suffix_dedup": (op9_suffix_dedup, SQL)}
