"""N-gram Jaccard join with Bayesian candidate pruning.

Documents of one shingle set are one class. Classes that agree in a band of MinHash
values are compared value by value: after each step the posterior probability that their
similarity reaches the threshold decides whether the comparison goes on. What survives is
joined into groups, and within a group all similarities are computed exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.components import components, pair_stars, spanning
from riskloom.llm.windows import WordHashes, gram_hashes, mixed
from riskloom.session import materialize

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values, values per band, and values compared before each look at the posterior.
VALUES, BAND, STEP = 128, 4, 16
#: A pair is dropped when reaching the threshold has become less probable than this.
TOLERANCE = 1e-7
#: Classes on one side of a block of candidates, and of a block that is verified.
BUCKET, GROUP = 512, 1_024
#: Rows that one task compares, about.
TASK_ROWS = 20_000

MULTIPLY = mixed(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
ADD = mixed(np.arange(1001, VALUES + 1001, dtype=np.uint64))


def shingle_set(text: bytes, known: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes. A text of fewer words is one shingle; one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(known.of(words), min(n, len(words))))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[i:i + 4096, None] * MULTIPLY + ADD).min(0))
    return mixed(out)


def fewest_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n values, the fewest matches for which the posterior still reaches the tolerance.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) belief; its weight
    above t is the chance that n + 1 draws of probability t give at most m.
    """
    least = {}
    for n in range(STEP, VALUES + 1, STEP):
        weight = 0.0
        for m in range(n + 1):
            weight += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if weight >= tolerance:
                least[n] = m
                break
    return least


def surviving(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs survive the incremental comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, fewest in least.items():
        part = slice(n - STEP, n)
        for i in range(0, len(alive), 65_536):
            r = alive[i:i + 65_536]
            matches[r] += (signatures[a[r], part] == signatures[b[r], part]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= fewest]
    return alive


def candidate_edges(table: pa.Table, least: dict[int, int]) -> pa.Table:
    """Star edges among the classes of one task's buckets that survive the comparison."""
    width = VALUES
    key = table.column("class").to_numpy()
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(key), width)
    # rows arrive in any order: bring buckets together, left side first
    columns = [table.column(c).to_numpy() for c in ("right_side", "high", "low", "bucket", "band")]
    order = np.lexsort(columns)
    change = np.zeros(len(order), bool)
    change[0] = True
    for c in columns[1:]:
        change[1:] |= c[order][1:] != c[order][:-1]
    starts = np.append(np.flatnonzero(change), len(order))
    right = columns[0][order]
    same = (columns[1] == columns[2])[order]
    found_a, found_b = [], []
    held_a, held_b, held = [], [], 0

    def settle():
        nonlocal held_a, held_b, held
        if held:
            a, b = np.concatenate(held_a), np.concatenate(held_b)
            alive = surviving(signatures, a, b, least)
            found_a.append(key[a[alive]])
            found_b.append(key[b[alive]])
        held_a, held_b, held = [], [], 0

    for s, e in zip(starts[:-1], starts[1:]):
        if same[s]:
            i, j = np.triu_indices(e - s, 1)
        else:
            split = s + int(np.searchsorted(right[s:e], 1))
            i, j = (g.ravel() for g in np.meshgrid(np.arange(split - s), np.arange(split - s, e - s), indexing="ij"))
        if len(i):
            held_a.append(order[s + i])
            held_b.append(order[s + j])
            held += len(i)
            if held > 200_000:
                settle()
    settle()
    if not found_a:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    nodes, roots = pair_stars(np.concatenate(found_a), np.concatenate(found_b))
    return pa.table({"a": nodes, "b": roots})


def blocked(rows: DataFrame, size: str, key: str, block: int) -> DataFrame:
    """Rows of crowded groups, given once for each pair of blocks they belong to.

    Adds ``low``, ``high`` (the pair of blocks) and ``right_side``. Rows of a group with one
    block come out once.
    """
    count = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("__mine", F.pmod(F.xxhash64(key, F.lit(3)), count).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select("*", F.least("__mine", "__other").alias("low"), F.greatest("__mine", "__other").alias("high"),
                       (F.col("__mine") > F.col("__other")).cast("int").alias("right_side")).drop("__mine", "__other")


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, dkey, set_a, set_b, n, bands, signature) per document row."""

    def sign(batches):
        known = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column(2):
                s = shingle_set((text.as_py() or "").encode(), known, shingle)
                if not len(s):
                    rows.append((0, 0, 0, [], b""))
                    continue
                values = min_hashes(s)
                bands = mixed(values.reshape(-1, BAND)[:, 0].copy())
                for i in range(1, BAND):
                    bands = mixed(bands * np.uint64(31) + values.reshape(-1, BAND)[:, i])
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((signed64(both >> 64), signed64(both), len(s), bands.view(np.int64), (values >> np.uint64(48)).astype(np.uint16).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())))],
                names=["doc_id", "dkey", "set_a", "set_b", "n", "bands", "signature"])

    return docs.mapInArrow(sign, "doc_id long, dkey long, set_a long, set_b long, n int, bands array<long>, signature binary")


def signed64(x: int) -> int:
    return ((x & (1 << 64) - 1) ^ (1 << 63)) - (1 << 63)


def verify_block(table: pa.Table, threshold: float, shingle: int) -> pa.Table:
    """Exact links between the two sides of a block, counted with copies."""
    known = WordHashes()
    sets = [shingle_set(t.encode(), known, shingle) for t in table.column("text").to_pylist()]
    key, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
    right = table.column("right_side").to_numpy().astype(bool)
    within = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    a = np.arange(len(key)) if within else np.flatnonzero(~right)
    b = a if within else np.flatnonzero(right)
    empty = np.empty(0, np.int64)
    if not len(a) or not len(b):
        return pa.table({"class": empty, "links": empty, "root": empty})
    common = overlaps([sets[i] for i in a], [sets[i] for i in b], within)
    sizes = np.array([len(s) for s in sets])
    union = sizes[a][:, None] + sizes[b][None] - common
    # in whole numbers wherever the threshold is a fraction of a million
    links = common * 1_000_000 >= union * round(threshold * 1_000_000)
    if within:
        np.fill_diagonal(links, False)
    count_a = links @ copies[b]
    nodes, roots = spanning(links, key[a], key[b])
    out_key, out_n = [key[a]], [count_a]
    if not within:
        out_key.append(key[b])
        out_n.append(links.T @ copies[a])
    keys, counts = np.concatenate(out_key), np.concatenate(out_n)
    some = counts > 0
    return pa.table({"class": np.concatenate((keys[some], nodes)),
                     "links": np.concatenate((counts[some], np.zeros(len(nodes), np.int64))),
                     "root": np.concatenate((keys[some], roots))})


def overlaps(left: list[np.ndarray], right: list[np.ndarray], within: bool) -> np.ndarray:
    """How many shingles each pair of sets shares."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    if within:
        names, times = np.unique(lv, return_counts=True)
        names = names[times > 1]
    else:
        names = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.int64)
    for i in range(0, len(names), 4096):
        part = names[i:i + 4096]
        x = presence(left, part)
        y = x if within else presence(right, part)
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def presence(sets: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(names)), np.float32)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    hit = names[at] == values
    x[owner[hit], at[hit]] = 1
    return x


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, dkey, class_id, n_links, component_id, kept), one row per document row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of
    fewer than ``shingle`` words is one shingle. ``class_id`` is the smallest id with the
    same set of shingles, ``n_links`` the number of other documents with a Jaccard
    similarity of at least ``threshold``, and ``component_id`` the smallest id reachable
    by links. Documents without words, or without an id, link with nothing. Repeated rows
    are documents of their own. ``dkey`` is the text's ``xxhash64``. Other columns are
    ignored. A linked pair is missed only if no band agrees (5e-8 at a similarity of 0.8
    and far less above) or if its matches lie below ``TOLERANCE``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("dkey"), text.alias("text"))
    signs = materialize(signed(rows, shingle), "signatures")
    classes = signs.filter("n > 0 and doc_id is not null").groupBy("set_a", "set_b", "n").agg(
        F.min(F.struct("doc_id", "dkey")).alias("place"), F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = materialize(classes.select(
        F.monotonically_increasing_id().alias("class"), "set_a", "set_b", "n", "place.doc_id", "place.dkey", "copies",
        "bands", "signature"), "classes")
    bands = classes.select("class", F.posexplode("bands").alias("band", "bucket"))
    crowded = bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = materialize(bands.join(crowded, ["band", "bucket"]), "buckets")
    # rows as they are once crowded buckets are given out in blocks
    total = members.agg(F.sum(F.ceil(F.col("members") / BUCKET))).first()[0] or 0
    members = blocked(members.join(classes.select("class", "signature"), "class"), "members", "class", BUCKET)
    tasks = max(1, -(-total // TASK_ROWS))
    least = fewest_matches(threshold, TOLERANCE)
    task = F.pmod(F.xxhash64("band", "bucket", "low", "high"), F.lit(tasks))
    edges = members.groupBy(task.alias("task")).applyInArrow(lambda t: candidate_edges(t, least), "a long, b long")
    groups = components(edges)
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root")
    part = classes.select("class", "doc_id", "dkey", "copies").join(sized, F.col("class") == F.col("node")).select(
        "class", F.col("doc_id").alias("c_id"), F.col("dkey").alias("c_key"), "copies", F.col("root").alias("cluster"), "members")
    texts = rows.join(part, (F.col("doc_id") == F.col("c_id")) & (F.col("dkey") == F.col("c_key"))).select(
        "class", "copies", "cluster", "members", "text")
    texts = blocked(texts.dropDuplicates(["class"]), "members", "class", GROUP)
    found = materialize(texts.groupBy("cluster", "low", "high").applyInArrow(
        lambda t: verify_block(t, threshold, shingle), "class long, links long, root long"), "verified")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "set_a", "set_b", "n", "doc_id", "copies").join(
        roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    least_id = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = named.join(least_id, "root").join(links, "class", "left").select(
        "set_a", "set_b", "n", F.col("doc_id").alias("class_id"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signs.select("doc_id", "dkey", "set_a", "set_b", F.when(F.col("doc_id").isNotNull(), F.col("n")).alias("n"))
    return out.join(known, ["set_a", "set_b", "n"], "left").select(
        "doc_id", "dkey", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True))).alias("kept"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, with all their columns.

    The smallest id of a group stays; of rows with that id and text, one.
    """
    kept = jaccard_links(docs, id_col, text_col, **settings).filter("kept")
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("dkey").alias("__kept_key")).distinct()
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].eqNullSafe(F.col("__kept_id")) & (F.xxhash64(text) == F.col("__kept_key"))
    rows = docs.join(kept, same, "left_semi").withColumn("__key", F.xxhash64(text))
    # rows without an id are documents of their own and all stay
    named = rows.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__key"])
    return named.unionByName(rows.filter(F.col(id_col).isNull())).drop("__key")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("dkey")


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') g
      from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) i from w where len(words) > 0)),
n as (select doc_id, count(*) n, md5(string_agg(g, chr(10) order by g)) k from s group by doc_id),
class as (select doc_id, min(doc_id) over (partition by k) class_id, n from n),
cs as (select s.doc_id, g from s join class using (doc_id) where doc_id = class_id),
x as (select a.doc_id a, b.doc_id b, count(*) c from cs a join cs b on a.g = b.g and a.doc_id < b.doc_id group by all),
p as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 10 * c >= 8 * (na.n + nb.n - c)),
l as (select a, b from p union all select b, a from p),
reach as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
size as (select class_id, count(*) copies from class group by class_id),
links as (select l.a, sum(copies) m from l join size on size.class_id = l.b group by l.a),
comp as (select a, min(b) least from reach group by a)
select w.doc_id, coalesce(class.class_id, w.doc_id) class_id,
       cast(coalesce(links.m, 0) + coalesce(copies - 1, 0) as bigint) n_links,
       least(coalesce(class.class_id, w.doc_id), coalesce(comp.least, w.doc_id)) component_id,
       w.doc_id = least(coalesce(class.class_id, w.doc_id), coalesce(comp.least, w.doc_id)) kept
from w left join class using (doc_id) left join size using (class_id)
left join links on links.a = class.class_id left join comp on comp.a = class.class_id
"""
QUERIES = {"op6_jaccard_join": (op6_jaccard_join, SQL)}
