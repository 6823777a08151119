"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each conditioned on the bits decided so far and on the
``DEPTH`` bytes before. Every context length keeps a Krichevsky-Trofimov estimate per
decision, and a node's weight against its longer contexts follows from how well either
would have coded the training corpus: ``P(node) = (KT(node) + prod P(child)) / 2``. A
decision's probability mixes the estimates along its path with those weights; the path
ends where the corpus ends, at the longest context seen. It sums to one over all texts,
as each text closes with a byte that UTF-8 does not use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.langid import remainder
from riskloom.llm.windows import mixed
from riskloom.session import materialize

#: Bytes of context.
DEPTH = 4
#: Closes a text, and stands before its first byte.
END = 0xFF
#: Nodes up to which the tree is broadcast (16 bytes each); a larger one is joined.
BROADCAST_NODES = 10_000_000
#: Rows of distinct strings that one task weighs, about.
TASK_GRAMS = 250_000
#: Bytes worked on at once, and places of the tables that remember strings within a task.
CHUNK, PLACES = 4_000_000, 1 << 21

GRAM_BITS = np.uint64(8 * (DEPTH + 1))
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``DEPTH`` before it as one number, text after text, and how many per text.

    The byte itself is lowest, then the nearest before it, and so on.
    """
    pad = bytes([END]) * DEPTH
    raw = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    code = np.zeros(len(raw) - DEPTH, np.uint64)
    for i in range(DEPTH + 1):
        byte = raw[DEPTH - i:len(raw) - i].astype(np.uint64)
        byte <<= np.uint64(8 * i)
        code |= byte
    del byte
    sizes = np.array([len(t) + 1 for t in texts])
    # what straddles two texts goes: the first DEPTH places of every later text
    keep = np.ones(len(code), bool)
    starts = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
    for i in range(DEPTH):
        keep[starts + i] = False
    return code[keep], sizes


def chunks(texts):
    """(first row, byte texts) of about ``CHUNK`` bytes."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


class Remembered:
    """A table of numbers by code with one place per hash; whoever comes first keeps it."""

    def __init__(self, kind):
        self.code = np.full(PLACES, EMPTY, np.uint64)
        self.value = np.zeros(PLACES, kind)

    def places(self, code: np.ndarray) -> np.ndarray:
        at = mixed(code)
        at >>= np.uint64(64 - (PLACES.bit_length() - 1))
        return at.view(np.int64)

    def claim(self, code: np.ndarray) -> None:
        """Give free places to new codes."""
        at = self.places(code)
        free = self.code[at] == EMPTY
        self.code[at[free]] = code[free]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, times) over all texts, summed within each task before the exchange."""

    def count(batches):
        table = Remembered(np.int64)
        for batch in batches:
            for _, texts in chunks(b" ".join(tokens_of(t.as_py())) for t in batch.column(0)):
                code, _ = gram_codes(texts)
                table.claim(code)
                at = table.places(code)
                own = table.code[at] == code
                table.value += np.bincount(at[own], minlength=PLACES)
                rest, times = np.unique(code[~own], return_counts=True)
                # else they stay while the next chunk is spelt
                del code, at, own
                if len(rest):
                    yield pa.RecordBatch.from_arrays([pa.array(rest.view(np.int64)), pa.array(times)], names=["gram", "times"])
                del rest, times
        used = np.flatnonzero(table.value)
        for i in range(0, len(used), 100_000):
            part = used[i:i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(table.code[part].view(np.int64)), pa.array(table.value[part])], names=["gram", "times"])

    return docs.select("text").mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, by Stirling's series after a shift."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift[small] -= np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def grouped(key: np.ndarray, *values: np.ndarray):
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values)


def level_counts(gram: np.ndarray, times: np.ndarray, depth: int):
    """(node, n0, n1) of all decisions at one context length. A node is context, then the bits so far after a 1."""
    code, times = grouped(gram & np.uint64((1 << 8 * (depth + 1)) - 1), times.astype(np.float64))
    byte, context = (code & np.uint64(255)) | np.uint64(256), code >> np.uint64(8)
    keys, zeros, ones = [], [], []
    for bit in range(8):
        key = (context << np.uint64(8)) | (byte >> np.uint64(8 - bit))
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        key, n0, n1 = grouped(key, np.where(one, 0, times), np.where(one, times, 0))
        keys.append(key)
        zeros.append(n0)
        ones.append(n1)
    return grouped(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def weigh(n0, n1, below: np.ndarray | None):
    """(ln P of the nodes, weight of their own estimate) given the sums of ln P of their children."""
    own = log_kt(n0, n1)
    if below is None:
        return own, np.ones_like(own)
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def parents(node: np.ndarray, depth: int) -> np.ndarray:
    """The node with the same bits and one byte of context less."""
    context, bits = node >> np.uint64(8), node & np.uint64(255)
    return ((context & np.uint64((1 << 8 * (depth - 1)) - 1)) << np.uint64(8)) | bits


def subtree(table: pa.Table) -> pa.Table:
    """All nodes of two and more bytes of context whose last two bytes are in this task."""
    gram, times = table.column("gram").to_numpy().view(np.uint64), table.column("times").to_numpy()
    out, below = [], None
    for depth in range(DEPTH, 1, -1):
        node, n0, n1 = level_counts(gram, times, depth)
        if below is None:
            total, own = weigh(n0, n1, None)
        else:
            keys, sums = below
            place = np.searchsorted(keys, node)
            total, own = weigh(n0, n1, sums[place])
        below = grouped(parents(node, depth), total)
        out.append((depth, node, n0, n1, own, total))
    return pa.table({
        "depth": pa.array(np.concatenate([np.full(len(o[1]), o[0], np.int32) for o in out])),
        "node": pa.array(np.concatenate([o[1] for o in out]).view(np.int64)),
        **{c: np.concatenate([o[i] for o in out]) for i, c in ((2, "n0"), (3, "n1"), (4, "own"), (5, "total"))}})


@dataclass
class Tree:
    """Per context length: sorted nodes, probability of a 1, and weight of the own estimate."""

    node: list[np.ndarray]
    one: list[np.ndarray]
    own: list[np.ndarray]

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """ln of the probability of each byte in its context."""
        out = np.zeros(len(code))
        byte = (code & np.uint64(255)) | np.uint64(256)
        for bit in range(8):
            prefix = byte >> np.uint64(8 - bit)
            one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            p, left, open_ = np.zeros(len(code)), np.ones(len(code)), np.ones(len(code), bool)
            last = np.full(len(code), 0.5)
            for depth in range(DEPTH + 1):
                nodes = self.node[depth]
                key = (((code >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | prefix
                at = np.minimum(np.searchsorted(nodes, key), max(len(nodes) - 1, 0))
                seen = open_ & (nodes[at] == key) if len(nodes) else np.zeros(len(code), bool)
                # the weight still open goes to the longest context seen
                p = np.where(open_ & ~seen, p + left * last, p)
                open_ = seen
                here = self.one[depth][at] if len(nodes) else last
                w = self.own[depth][at] if len(nodes) else last
                p = np.where(seen, p + left * w * here, p)
                left = np.where(seen, left * (1 - w), left)
                last = np.where(seen, here, last)
            p = np.where(open_, p + left * last, p)
            out += np.log(np.where(one, p, 1 - p))
        return out


NODES = "depth int, node long, n0 double, n1 double, own double, total double"


def grow(counts: DataFrame) -> DataFrame:
    """(depth, node, one, own) for the whole tree, from the counts of all strings.

    Longer contexts are weighed in tasks of their own by their last two bytes; what they
    add up to below the shorter ones has at most 65,280 rows.
    """
    spark = counts.sparkSession
    tasks = max(1, -(-counts.count() // TASK_GRAMS))
    last_two = F.shiftright("gram", 8).bitwiseAND(65535)
    deep = materialize(counts.groupBy(F.pmod(F.xxhash64(last_two), F.lit(tasks)).alias("task")).applyInArrow(
        subtree, NODES), "nodes")
    # bits and last byte of the context: one byte of context left
    kept = F.col("node").bitwiseAND(65535)
    one_byte = deep.filter("depth = 2").groupBy(kept.alias("node")).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("below")).toArrow()
    node, n0, n1, below = (one_byte[c].to_numpy() for c in ("node", "n0", "n1", "below"))
    total, own = weigh(n0, n1, below)
    shallow = [(1, int(k), float(b / (a + b)), float(o)) for k, a, b, o in zip(node, n0 + 0.5, n1 + 0.5, own)]
    top, m0, m1, beneath = grouped(node.astype(np.uint64) & np.uint64(255), n0, n1, total)
    _, own = weigh(m0, m1, beneath)
    shallow += [(0, int(k), float(b / (a + b)), float(o)) for k, a, b, o in zip(top, m0 + 0.5, m1 + 0.5, own)]
    upper = spark.createDataFrame(shallow, "depth int, node long, one double, own double")
    lower = deep.select("depth", "node", ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("one"), "own")
    return lower.unionByName(upper)


def collected(tree: DataFrame) -> Tree:
    table = tree.select("depth", "node", F.col("one").cast("float"), F.col("own").cast("float")).toArrow()
    depth, node = table["depth"].to_numpy(), table["node"].to_numpy().view(np.uint64)
    parts = []
    for d in range(DEPTH + 1):
        pick = np.flatnonzero(depth == d)
        pick = pick[np.argsort(node[pick])]
        parts.append((node[pick], table["one"].to_numpy()[pick], table["own"].to_numpy()[pick]))
    return Tree(*(list(x) for x in zip(*parts)))


def code_lengths(docs: DataFrame, tree: DataFrame, limit: int = BROADCAST_NODES) -> DataFrame:
    """(doc_id, dkey, n_bytes, ln_p) for rows (doc_id, dkey, text): ln of each text's probability.

    A tree of known small size is broadcast, and tasks remember the strings they have
    worked out. For a larger one the distinct strings of all texts are joined with the
    nodes on their paths, and their values with the texts.
    """
    spark = docs.sparkSession
    tree = materialize(tree, "tree")
    if tree.count() <= limit:
        sent = spark.sparkContext.broadcast(collected(tree))

        def score(batches):
            model, table = sent.value, Remembered(np.float64)
            for batch in batches:
                sums, sizes = [], []
                for _, texts in chunks(b" ".join(tokens_of(t.as_py())) for t in batch.column(2)):
                    code, size = gram_codes(texts)
                    at = table.places(code)
                    new = np.unique(code[table.code[at] == EMPTY])
                    if len(new):
                        table.claim(new)
                        place = table.places(new)
                        own = table.code[place] == new
                        table.value[place[own]] = model.log_probability(new[own])
                    value = table.value[at]
                    miss = np.flatnonzero(table.code[at] != code)
                    if len(miss):
                        rest, where = np.unique(code[miss], return_inverse=True)
                        value[miss] = model.log_probability(rest)[where]
                    sums.append(np.add.reduceat(value, np.cumsum(size) - size))
                    sizes.append(size - 1)
                    # else they stay while the next chunk is spelt
                    rest = where = place = own = None
                    del code, at, new, value, miss
                none = np.empty(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.concatenate([*sizes, none]).astype(np.int64)),
                     pa.array(np.concatenate([*sums, none]))], names=["doc_id", "dkey", "n_bytes", "ln_p"])

        return docs.select("doc_id", "dkey", "text").mapInArrow(score, "doc_id long, dkey long, n_bytes long, ln_p double")

    def spell(batches):
        for batch in batches:
            for row in range(len(batch)):
                code, size = gram_codes([b" ".join(tokens_of(batch.column(2)[row].as_py()))])
                gram, times = np.unique(code, return_counts=True)
                one = pa.array(np.zeros(len(gram), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(gram), row))), batch.column(1).take(pa.array(np.full(len(gram), row))),
                     pa.array(gram.view(np.int64)), pa.array(times)], names=["doc_id", "dkey", "gram", "times"])

    spelt = materialize(docs.select("doc_id", "dkey", "text").mapInArrow(
        spell, "doc_id long, dkey long, gram long, times long"), "spelt")
    bit, depth = F.explode(F.sequence(F.lit(0), F.lit(7))), F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    steps = spelt.select("gram").distinct().withColumn("bit", bit).withColumn("depth", depth)
    byte = F.col("gram").bitwiseAND(255).bitwiseOR(256)
    context = F.expr("shiftright(gram, 8) & (shiftleft(1L, 8 * depth) - 1)")
    steps = steps.withColumn("byte", byte).withColumn("context", context)
    steps = steps.withColumn("node", F.expr("shiftleft(context, 8) | shiftright(byte, 8 - bit)"))
    path = steps.join(tree, ["depth", "node"], "left").groupBy("gram", "bit", "byte").agg(
        F.sort_array(F.collect_list(F.struct("depth", F.col("one").cast("float").cast("double").alias("one"),
                                             F.col("own").cast("float").cast("double").alias("own")))).alias("path"))
    # (probability so far, weight left, longest estimate, still on the path)
    start = F.struct(F.lit(0.0).alias("p"), F.lit(1.0).alias("left"), F.lit(0.5).alias("last"), F.lit(True).alias("open"))

    def step(s, x):
        seen = s["open"] & x["one"].isNotNull()
        ends = s["open"] & x["one"].isNull()
        return F.struct(
            F.when(seen, s["p"] + s["left"] * x["own"] * x["one"]).when(ends, s["p"] + s["left"] * s["last"]).otherwise(s["p"]).alias("p"),
            F.when(seen, s["left"] * (1 - x["own"])).otherwise(s["left"]).alias("left"),
            F.when(seen, x["one"]).otherwise(s["last"]).alias("last"), seen.alias("open"))

    p = F.aggregate("path", start, step, lambda s: F.when(s["open"], s["p"] + s["left"] * s["last"]).otherwise(s["p"]))
    known = path.withColumn("p", p).withColumn("one", F.expr("shiftright(byte, 7 - bit) & 1"))
    known = known.groupBy("gram").agg(F.sum(F.log(F.when(F.col("one") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("ln"))
    # rows of one id and text were spelt once each and share their value
    per_doc = spelt.join(known, "gram").groupBy("doc_id", "dkey").agg(
        F.sum(F.col("times") * F.col("ln")).alias("ln"), F.sum("times").alias("n"),
        F.sum(F.when(F.col("gram").bitwiseAND(255) == END, F.col("times")).otherwise(0)).alias("rows"))
    return per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        "doc_id", "dkey", (F.col("n") / F.col("rows") - 1).cast("long").alias("n_bytes"), (F.col("ln") / F.col("rows")).alias("ln_p"))


END_TOKEN = int(xxhash.xxh64_intdigest(b"\xff")) >> 1
#: Stands in a word list beside the number of all tokens of its part; hashes are not negative.
TOKENS = -1


def slices(texts: pa.Array):
    """(first row, texts) of about ``CHUNK`` bytes; a longer text is one by itself."""
    ends = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(63-bit hashes of the distinct tokens, which of them stand where, tokens per text).

    The words of :func:`tokens_of` with the end of its text after each text's last one;
    a distinct word is hashed once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
    # white space at either end of a text leaves an empty piece
    full = pc.greater(pc.binary_length(flat), 0)
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(sizes))
    words = flat.filter(full).dictionary_encode()
    hashes = [xxhash.xxh64_intdigest(w) >> 1 for w in words.dictionary.cast(pa.binary()).to_pylist()]
    at = np.insert(words.indices.to_numpy(), np.cumsum(sizes), len(hashes))
    return np.array([*hashes, END_TOKEN], np.int64), at, sizes + 1


def word_base(docs: DataFrame) -> tuple[DataFrame, int]:
    """((doc_id, dkey, n_tokens, n_known, base_score), N): a unigram model over words.

    ``docs`` has (doc_id, dkey, text, train, part), where ``part`` names a stretch of the
    input of bounded size, the same whenever it is read. Each part lists its distinct
    words once; counts come back to the parts, and each part scores its documents with
    its own list. So texts move once, and a frequent word is one row per part. A list also
    holds its part's number of tokens, and a part that has another number when it is
    scored is an error.
    """

    def listed(batches):
        for batch in batches:
            found = {}
            for at, texts in slices(batch.column(2)):
                where, train = (batch.column(i).slice(at, len(texts)).to_numpy(zero_copy_only=False) for i in range(2))
                hashes, word, sizes = words_of(texts)
                of, trained = np.repeat(where, sizes), np.repeat(train, sizes)
                for p in np.unique(where).tolist():
                    pick = of == p
                    here, place = np.unique(word[pick], return_inverse=True)
                    times = np.bincount(place, trained[pick], len(here)).astype(np.int64)
                    found.setdefault(p, []).append((np.append(hashes[here], TOKENS), np.append(times, pick.sum())))
            for p, lists in found.items():
                word, times = grouped(*(np.concatenate(x) for x in zip(*lists)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(word), p, np.int64)), pa.array(word), pa.array(times)], names=["part", "word", "times"])

    lists = materialize(docs.select("part", "train", "text").mapInArrow(listed, "part long, word long, times long").groupBy(
        "part", "word").agg(F.sum("times").alias("times")), "words")
    counts = lists.groupBy("word").agg(F.sum("times").alias("c"))
    n, v = materialize(counts.filter(f"c > 0 and word <> {TOKENS}"), "counts").agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = n or 0, v or 0
    known = lists.join(counts, "word").filter("c > 0").select(
        "part", "word", F.when(F.col("word") == TOKENS, F.col("times")).otherwise(F.col("c")).alias("c"))
    floor, empty_longs = np.log10(n + 0.1 * (v + 1)), np.empty(0, np.int64)

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        word, c = words.column("word").to_numpy(), words.column("c").to_numpy()
        listed_tokens = c[word == TOKENS].sum()
        word, c = word[word != TOKENS], c[word != TOKENS]
        order = np.argsort(word)
        word, c = np.append(word[order], -1), np.append(c[order], 0)
        n_tokens, n_known, base = [empty_longs], [empty_longs], [np.empty(0)]
        for _, text in (x for chunk in texts.column("text").chunks for x in slices(chunk)):
            hashes, at, sizes = words_of(text)
            place = np.searchsorted(word[:-1], hashes)
            seen = np.where(word[place] == hashes, c[place], 0)
            starts = np.cumsum(sizes) - sizes
            n_tokens.append(sizes)
            n_known.append(np.add.reduceat((seen > 0).astype(np.int64)[at], starts))
            base.append(np.add.reduceat((np.log10(seen + 0.1) - floor)[at], starts))
        if (tokens := sum(int(x.sum()) for x in n_tokens)) != listed_tokens:
            raise ValueError(f"a part with {tokens} tokens has a word list of {listed_tokens}")
        return pa.table({"doc_id": texts.column("doc_id"), "dkey": texts.column("dkey"), "n_tokens": np.concatenate(n_tokens),
                         "n_known": np.concatenate(n_known), "base_score": np.concatenate(base)})

    out = docs.select("doc_id", "dkey", "text", "part").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(
        score, "doc_id long, dkey long, n_tokens long, n_known long, base_score double")
    return out, int(n)


def language_model_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          limit: int = BROADCAST_NODES) -> DataFrame:
    """(doc_id, dkey, n_bytes, ln_p): every text of ``docs`` under a tree learnt from ``training``.

    The model reads a text's words, A-Z lower-cased and joined by one space, as bytes. A
    null text is empty; it still has to close. Repeated rows are scored alike. Without
    training data every bit costs one bit. Other columns are ignored.
    """
    learnt = training.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tree = grow(materialize(gram_counts(learnt), "grams"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return code_lengths(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("dkey"), text.alias("text")),
                        tree, limit)


#: Bytes of a file that one part of the word lists covers, about.
PART_BYTES = 16 << 20
#: Texts so many times as long as the mean go to parts of their own.
LONGER = 16


def row_parts(source: DataFrame) -> Column:
    """Names the part of a row read from Parquet: its file, its place in the file, and how much longer than the mean its text is.

    Splits follow the cores at hand and may be cut elsewhere when a file is read again; a
    row's place in its file stays. Texts of ``LONGER`` times the mean, of that times the
    mean and so on step through fewer rows, so no part has more than ``LONGER`` times
    what one has on average, unless a single text has.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    n, total = source.agg(F.count(F.lit(1)), F.sum(size)).first()
    stored = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    mean, rows = max(1, -(-(total or 0) // max(1, n))), max(1, n * PART_BYTES // max(1, stored))
    level, step, k = F.lit(0), F.lit(rows), 1
    while mean * LONGER ** k < 1 << 31:
        longer = size >= mean * LONGER ** k
        level, step = F.when(longer, k).otherwise(level), F.when(longer, max(1, rows // LONGER ** k)).otherwise(step)
        k += 1
    return F.xxhash64("_metadata.file_path", level, F.floor(F.col("_metadata.row_index") / step))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = source.select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    scores = language_model_scores(docs, docs.filter(remainder("doc_id", 10) != 0))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = source.select("doc_id", F.xxhash64(text).alias("dkey"), text.alias("text"), row_parts(source).alias("part"),
                          F.coalesce(remainder("doc_id", 10) != 0, F.lit(False)).alias("train"))
    base, n = word_base(keyed)
    once = scores.dropDuplicates(["doc_id", "dkey"]).select(
        F.col("doc_id").alias("s_id"), F.col("dkey").alias("s_key"), (F.col("ln_p") / np.log(10)).alias("score"))
    both = base.join(once, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("dkey") == F.col("s_key")))
    return both.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       "base_score", "score")


QUERIES = {"op7_language_model": (op7_language_model, None)}
