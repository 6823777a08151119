"""Models, packing, sharding, decontamination and the pipeline against brute force or held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontaminate, langid, lm, packing, quality, sharding, text_tokens
from riskloom.llm.text_tokens import WordTokens
from riskloom.llm.windows import WordHashes  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("run", [4 << 20, 7])
def test_tokens_equal_the_tokenizers(monkeypatch, run):
    monkeypatch.setattr(text_tokens, "RUN", run)
    tool = WordTokens(packing.vocabulary_path(), keep=50)
    texts = ["", " ", "Hello, World!! it's 12a3", "É Ünder ªµº ß", "a\x1cb", "日本 text x y", "don't<|endoftext|>x",
             "x" * 300, "tab\tnew\nline", "a\x0bb\x85c\xa0d 'e f' 'g' don't.x", "İstanbul Σας", "$$$ *** a|b|c 99%"] + [f"word{i} Weird'{i}s" for i in range(80)]
    for text in texts + [" ".join(texts)]:
        assert tool.ids(text) == np.array(tool.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert tool.many(texts) == [tool.plain(t) for t in texts] and tool.many([]) == []


def test_packing_is_whole_and_gapless(odd_docs, odd_rows, no_docs):
    size = 64
    rows = packing.pack(odd_docs, size=size).collect()
    tool = WordTokens(packing.vocabulary_path())
    want = Counter()
    for doc, text in odd_rows:
        raw = tool.plain(text or "") + b"\0\0\0\0"
        for p, at in enumerate(range(0, len(raw), 4 * size)):
            part = raw[at:at + 4 * size]
            want[(doc, p, at // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= size
    total = sum(r["length"] for r in rows)
    assert len(places) <= 1.15 * math.ceil(total / size) + 1
    assert packing.pack(no_docs).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    lengths = np.array([5, 5, 3, 5, 2, 7, 4, 1, 9, 10, 6])
    bins, _ = packing.sum_of_squares(lengths, 10)
    gaps = {}
    for s, b in zip(lengths.tolist(), bins.tolist()):
        before = Counter(g for g in gaps.values() if g)

        def after(gap, s=s, before=before):
            c = before.copy()
            if gap < 10:
                c[gap] -= 1
            if gap > s:
                c[gap - s] += 1
            return sum(v * v for v in c.values())

        least = min(after(g) for g in [*before, 10] if g >= s)
        assert after(gaps.get(b, 10)) == least
        gaps[b] = gaps.get(b, 10) - s


@pytest.mark.parametrize("limit, anchors", [(1000, 0), (0, 1000), (0, 0)])
def test_contamination(spark, odd_docs, odd_rows, no_docs, limit, anchors):
    items = [(1, "Alpha BETA"), (2, None), (3, ""), (10, " ".join((odd_rows[4][1] or "").split()[3:20])), (None, "x"), (11, "né x"), (12, "Alpha beta")]
    bench = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, words string")
    got = decontaminate.contamination(odd_docs, bench, limit=limit, anchor_limit=anchors).collect()

    def words(t):
        low = (t or "").translate({ord(c): c.lower() for c in decontaminate.UPPER})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    want = []
    for doc, text in odd_rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(10, len(b))
            if item is None or not n:
                continue
            known = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in known:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        want.append((doc, len(w), len(hit), sorted(found)))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == sorted(want, key=str)
    clean = decontaminate.clean_documents(odd_docs, bench, limit=limit)
    assert clean.columns == odd_docs.columns
    assert clean.count() == sum(1 for w in want if not w[2])
    assert decontaminate.contamination(no_docs, bench, limit=limit).count() == 0
    assert decontaminate.contamination(odd_docs, bench.limit(0), limit=limit).filter("n_hit > 0").count() == 0


def test_language_id(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()
    model = langid.learn(langid.training_rows(docs))
    odd = langid.identify(odd_docs, model=model).select("doc_id", "text", "__language.*").collect()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in odd)
    empty = langid.learn(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, model=empty).select("__language.*").collect()} == {"und"}
    assert langid.identify(no_docs).count() == 0


def test_bloom_counts_are_corrected():
    texts = ["the cat sat on the mat " * 20, "le chat est sur la table " * 20]
    grams, sizes = langid.gram_codes(texts)
    assert sizes.sum() == len(grams)
    framed = " " + re.sub(r"[^a-z]+", " ", texts[0]).strip() + " "
    assert sizes[0] == sum(len(framed) - n + 1 for n in langid.GRAMS)


def test_quality(spark, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.op5_quality(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    rank, y = found.score.rank().to_numpy(), found.quality.to_numpy()
    good, bad = (y == 1).sum(), (y == 0).sum()
    assert (rank[y == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.95
    assert (found.predicted == y).mean() > 0.93
    model = quality.learn(no_docs, labels.limit(0))
    assert np.allclose(model.score(quality.matrix(["", None, "a b"])), 0.5)


def test_preferences_are_learnt():
    draws = np.random.default_rng(0)
    x = draws.normal(size=(400, 3))
    true = np.array([2.0, -1.0, 0.0])
    a, b = x[:200], x[200:]
    first = draws.random(200) < 1 / (1 + np.exp(-(a - b) @ true))
    w = quality.preference_fit(np.where(first[:, None], a, b), np.where(first[:, None], b, a))
    assert w[0] > 1 and w[1] < -0.4 and abs(w[2]) < 0.6


def test_tree_probabilities_sum_to_one(spark, odd_docs):
    tree = lm.collected(lm.grow(lm.gram_counts(odd_docs.na.fill(""))))
    for context in (b"alph", b"\xff\xff\xff\xff", b"zzzz", b"et a", b"qqbe"):
        code = np.uint64(0)
        for i in range(lm.DEPTH):
            code |= np.uint64(context[len(context) - 1 - i]) << np.uint64(8 * (i + 1))
        codes = code | np.arange(256, dtype=np.uint64)
        assert abs(np.exp(tree.log_probability(codes)).sum() - 1) < 1e-6


def test_weights_follow_the_recursion():
    n0, n1 = np.array([3.0, 0.0]), np.array([1.0, 2.0])
    kt = [np.prod([0.5 / 1, 1.5 / 2, 2.5 / 3, 0.5 / 4]), 0.5 / 1 * 1.5 / 2]
    assert np.allclose(np.exp(lm.log_kt(n0, n1)), kt)
    total, own = lm.weigh(n0, n1, np.log([0.1, 0.2]))
    assert np.allclose(np.exp(total), (np.array(kt) + [0.1, 0.2]) / 2) and np.allclose(own, kt / (2 * np.exp(total)))


def test_both_ways_of_scoring_agree(spark, odd_docs, no_docs):
    train = odd_docs.filter("doc_id < 30")
    small = lm.language_model_scores(odd_docs, train).collect()
    large = lm.language_model_scores(odd_docs, train, limit=0).collect()
    key = lambda r: (str(r["doc_id"]), r["dkey"])
    assert [key(r) + (r["n_bytes"],) for r in sorted(small, key=key)] == [key(r) + (r["n_bytes"],) for r in sorted(large, key=key)]
    assert np.allclose([r["ln_p"] for r in sorted(small, key=key)], [r["ln_p"] for r in sorted(large, key=key)], rtol=1e-6)
    none = lm.language_model_scores(odd_docs, no_docs).collect()
    assert all(np.isclose(r["ln_p"], -8 * (r["n_bytes"] + 1) * np.log(2)) for r in none)
    assert lm.language_model_scores(no_docs, no_docs).count() == 0


def test_word_base(odd_docs, odd_rows):
    rows = odd_docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("dkey"), F.coalesce("text", F.lit("")).alias("text"),
                           (F.coalesce("doc_id", F.lit(0)) % 2 == 0).alias("train"), (F.coalesce("doc_id", F.lit(0)) % 3).alias("part"))
    got, n = lm.word_base(rows)
    c, tokens = Counter(), []
    for doc, text in odd_rows:
        words = [*(text or "").encode().lower().split(), None]
        tokens.append((doc, words))
        if (doc or 0) % 2 == 0:
            c.update(words)
    assert n == sum(c.values())
    bottom = n + 0.1 * (len(c) + 1)
    want = [(doc, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / bottom) for x in w), 6)) for doc, w in tokens]
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got.collect()), key=str) == sorted(want, key=str)


def test_shards(spark, odd_docs, odd_rows, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert 0 <= s < 8 and slots == list(range(len(slots)))
    assert sharding.shard_documents(no_docs).count() == 0
    found = sharding.op8_sharding(spark, SF).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.01 * sizes.mean()
    kinds = found.groupby(["text_crc32", "size"])["shard"].nunique()
    assert (kinds > 1).mean() < 0.02


def test_propagation_gathers_linked_nodes_under_quotas(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"))
    links = nodes.select("node", F.floor(F.col("node") / 5).alias("link")).unionByName(
        nodes.filter("node < 300").select("node", F.lit(-1).cast("long").alias("link")))
    got = {r["node"]: r["shard"] for r in sharding.propagate(nodes, links, shards=4).collect()}
    counts = Counter(got.values())
    assert len(got) == 400 and max(counts.values()) <= 110
    kept = sum(got[5 * g] == got[5 * g + i] for g in range(80) for i in range(1, 5))
    assert kept > 160


def test_pipeline_stages(spark, odd_docs, no_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (odd_docs, no_docs):
            out = stage(spark, rows, "/root/testdata/sf0.001")
            assert i == 4 or out.columns == rows.columns
            out.count()
    kept = corpus_pipeline.known_language(spark, docs, "/root/testdata/sf0.001")
    assert kept.count() == docs.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns[:3] == ["doc_id", "piece", "start"]


def test_word_lists_outlive_other_splits(spark, odd_rows, tmp_path, monkeypatch):
    rows = [(i, f"{t or ''} own{i % 7} w{i}") for i, (_, t) in enumerate(odd_rows * 3)]
    path, kept = str(tmp_path / "docs"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), f"{tmp_path}/docs", row_group_size=5)
    monkeypatch.setattr(lm, "PART_BYTES", 1000)
    source = spark.read.parquet(path)
    keyed = source.select("doc_id", F.xxhash64("text").alias("dkey"), "text", lm.row_parts(source).alias("part"), F.lit(True).alias("train"))
    moved = keyed.withColumn("part", F.col("_metadata.file_block_start"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        before = {r["doc_id"]: r["part"] for r in keyed.collect()}
        base, n = lm.word_base(keyed)
        broken, _ = lm.word_base(moved)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2600")
        after = {r["doc_id"]: r["part"] for r in keyed.collect()}
        got = base.collect()
        with pytest.raises(Exception, match="word list"):
            broken.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert before == after and len(set(before.values())) > 3
    words = {i: [*t.encode().lower().split(), None] for i, t in rows}
    c = Counter(w for x in words.values() for w in x)
    bottom = n + 0.1 * (len(c) + 1)
    assert n == sum(c.values()) and len(got) == len(rows)
    for r in got:
        mine = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (len(mine), len(mine))
        assert np.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / bottom) for w in mine))
