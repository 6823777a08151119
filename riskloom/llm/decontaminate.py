"""Benchmark decontamination, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a window; an item with fewer is one window.
WINDOW = 10
#: Distinct benchmark windows that are broadcast whole. Of a larger set the hashes of the anchors are broadcast.
BROADCAST_WINDOWS = 50_000
#: Anchors whose hashes are broadcast, 8 bytes each and as much again for the table. Of a still larger set none are.
BROADCAST_ANCHORS = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits, lower-case a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """The normalised words of a text; a null text has none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(anchor, offset, len, w, items): each distinct window with the items that hold it.

    The anchor is the window's longest word, which is rare in running text; ``offset`` is
    its first place in the window, from 1.
    """
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), F.explode(F.array(words_of(text_col))).alias("words"))
    words = words.filter((F.size("words") > 0) & F.col("item").isNotNull())
    length = F.least(F.size("words"), F.lit(window))
    cut = words.select("item", "words", length.alias("len")).select(
        "item", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("i"), "words")
    cut = cut.select("item", "len", F.slice("words", F.col("i"), F.col("len")).alias("w"))
    kinds = cut.groupBy("w", "len").agg(F.collect_set("item").alias("items"))
    anchor = F.array_max(F.transform("w", lambda x: F.struct(F.length(x), x.alias("word"))))["word"]
    return kinds.withColumn("anchor", anchor).select(
        "anchor", F.array_position("w", F.col("anchor")).cast("int").alias("offset"), "len", "w", "items")


def places(docs: DataFrame, id_col: str, text_col: str, window: int, anchors: list[str] | None) -> DataFrame:
    """(doc_id, dkey, n_words, at, word, head, around): the words that may be an anchor.

    ``around`` holds the words that a window through place ``at`` can reach, from place
    ``head`` on. Each document also gives one row without a place. ``anchors`` is the
    broadcast set; without it every word is listed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def scan(w: Column) -> Column:
        at = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
        if anchors is not None:
            at = F.filter(at, lambda i: F.get(w, i - 1).isin(anchors))
        head = lambda i: F.greatest(i - (window - 1), F.lit(1))
        found = F.transform(at, lambda i: F.struct(
            i.alias("at"), F.get(w, i - 1).alias("word"), head(i).alias("head"),
            F.slice(w, head(i), i - head(i) + window).alias("around")))
        none = F.lit(None).cast("struct<at:int,word:string,head:int,around:array<string>>")
        return F.struct(F.size(w).alias("n_words"), F.concat(F.array(none), found).alias("found"))

    # the generator evaluates a document's words once, whatever is asked of them later
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("dkey"),
                       F.inline(F.transform(F.array(words_of(text_col)), scan)))
    return rows.select("doc_id", "dkey", "n_words", F.explode("found").alias("p")).select(
        "doc_id", "dkey", "n_words", "p.*")


def hits(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, window: int, limit: int,
         anchor_limit: int) -> DataFrame:
    """(doc_id, dkey, n_words, at, size, items): a row per document without ``at``, and one per hit.

    The set of windows is broadcast as long as it is known to be small; then a document's words never leave their
    task. Of a larger set the hashes of the anchors go to the tasks, and only words that may be an
    anchor meet the windows in a shuffle. Where even the hashes are too many, all words do.
    """
    small = windows.count() <= limit
    heads = windows.select("anchor").distinct()
    anchors = [r["anchor"] for r in heads.collect()] if small else None
    found = places(docs, id_col, text_col, window, anchors)
    if not small and heads.count() <= anchor_limit:
        hashes = heads.select(F.xxhash64("anchor").alias("h")).distinct()
        found = found.join(F.broadcast(hashes), F.xxhash64("word") == F.col("h"), "left")
        found = found.filter(F.col("at").isNull() | F.col("h").isNotNull()).drop("h")
    side = F.broadcast(windows) if small else windows
    joined = found.join(side, F.col("word") == F.col("anchor"), "left")
    first = F.col("at") - F.col("offset") + 1
    same = F.when(first >= 1, F.slice("around", first - F.col("head") + 1, F.col("len")) == F.col("w"))
    joined = joined.filter(F.col("at").isNull() | F.coalesce(same, F.lit(False)))
    return joined.select("doc_id", "dkey", "n_words", first.alias("at"), F.col("len").alias("size"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  limit: int = BROADCAST_WINDOWS, anchor_limit: int = BROADCAST_ANCHORS) -> DataFrame:
    """(doc_id, dkey, n_words, n_hit, items, spans) for each row of ``docs``.

    ``spans`` lists the (at, size) of the windows found, from word 1; ``items`` the
    items they come from, sorted as strings; ``n_hit`` counts the words inside any of
    them. ``dkey`` is the text's ``xxhash64``. Null and empty texts have no words and
    hit nothing, in documents and in items; items without an id are left out. Repeated
    rows come out as often as they went in. Other columns are ignored.
    """
    windows = item_windows(benchmark, item_col, item_text, window)
    found = hits(docs, windows, id_col, text_col, window, limit, anchor_limit)
    per_doc = found.groupBy("doc_id", "dkey").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("at").isNull(), 1).otherwise(0)).alias("copies"),
        F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "size"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    inside = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))
    per_doc = per_doc.withColumn("n_hit", F.size(F.array_distinct(F.flatten(inside))).cast("long"))
    return per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "dkey", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items", "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    **settings) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    dirty = contamination(docs, benchmark, id_col, text_col, **settings).filter("n_hit > 0")
    dirty = dirty.select(F.col("doc_id").alias("__dirty_id"), F.col("dkey").alias("__dirty_key")).distinct()
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].eqNullSafe(F.col("__dirty_id")) & (F.xxhash64(text) == F.col("__dirty_key"))
    return docs.join(dirty, same, "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from benchmark),
bw as (select distinct cast(item_id as varchar) item, l, array_to_string(w[i:i + l - 1], ' ') win
       from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) i
             from (select *, least(len(w), 10) l from b where len(w) > 0))),
dw as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') win
       from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i
             from d, (select distinct l from bw) where len(w) >= l)),
h as (select doc_id, i, dw.l, item from dw join bw on dw.win = bw.win and dw.l = bw.l),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from h) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
      from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
       cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""
QUERIES = {"op10_decontamination": (op10_decontamination, SQL)}
