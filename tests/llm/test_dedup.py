"""Deduplication and joins against brute force."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import embedding_join, jaccard_join, repeats, substring, suffix_array, windows


def test_equal_windows_share_their_anchor():
    draws = np.random.default_rng(1)
    letters = draws.integers(0, 2 ** 63, 3).astype(np.uint64)
    for length, window, k in itertools.product((5, 40, 400, 3000), (12, 20), (4, 12)):
        text = letters[draws.integers(0, 3 if length > 100 else 1, length)]
        bounds = np.array([0, length // 3, length])
        anchor = {}
        doc, start, n, anchors, again = windows.segments(text, bounds, window, k)
        seen = Counter()
        for d, s, m, a, r in zip(doc, start, n, anchors, again):
            inside = []
            for i in range(s, s + m):
                w = text[bounds[d] + i:bounds[d] + i + window].tobytes()
                assert anchor.setdefault(w, a) == a
                inside.append(w)
                seen[d] += 1
            assert r or len(set(inside)) == len(inside)
        for d in range(2):
            assert seen[d] == max(0, bounds[d + 1] - bounds[d] - window + 1)


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    values = [0, 1, -1, 2 ** 62, -2 ** 63, 12345678901]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v", F.lit(1))).collect()
    want = repeats.spark_hash_long(np.array(values, np.int64), 1).view(np.int64)
    assert [r[0] for r in got] == want.tolist()


def brute_words(rows, window):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i:i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, window):
    times = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        times.update(raw[i:i + window] for i in range(len(raw) - window + 1))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - window + 1):
            if times[raw[i:i + window]] > 1:
                gone[i:i + window] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


#: Usual limits; every anchor counted by windows; only ruled lines; long texts in pieces; no filter; many shards.
LIMITS = [{}, {"HOT": 0}, {"HOT": 40}, {"CHUNK": 64}, {"FILTER_BITS": 10}, {"SHARD_PLACES": 5, "HOT_SHARDS": 0}]


@pytest.mark.parametrize("settings", LIMITS)
def test_substring_dedup(spark, odd_docs, odd_rows, monkeypatch, settings):
    for limit, value in settings.items():
        monkeypatch.setattr(repeats, limit, value)
    got = substring.substring_dedup(odd_docs, window=12, anchor=5).mapInArrow(
        substring.digest, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(odd_rows, 12)


@pytest.mark.parametrize("settings", LIMITS)
def test_suffix_dedup(spark, odd_docs, odd_rows, monkeypatch, settings):
    for limit, value in settings.items():
        monkeypatch.setattr(repeats, limit, value)
    got = suffix_array.suffix_dedup(odd_docs, window=40, anchor=10).mapInArrow(
        suffix_array.digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(odd_rows, 40)


@pytest.mark.parametrize("settings", [{}, {"HOT": 100}, {"HOT": 100, "CHUNK": 150}])
def test_ruled_lines(spark, monkeypatch, settings):
    for limit, value in settings.items():
        monkeypatch.setattr(repeats, limit, value)
    draws = np.random.default_rng(6)
    rows = [(i, f"head {draws.integers(10 ** 9)}\n" + "-" * (60 + 7 * (i % 9)) + f"\nrow {draws.integers(10 ** 9)} " + "=" * (i + 10)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_array.suffix_dedup(docs, window=40, anchor=10).mapInArrow(
        suffix_array.digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 40)
    assert any(r["n_spans"] > 1 for r in got)
    words = [(i, " ".join(c if c in "-=" else c + str(i % 3) for c in t if not c.isspace())) for i, t in rows]
    got = substring.substring_dedup(spark.createDataFrame(words, "doc_id long, text string"), window=12, anchor=5).mapInArrow(
        substring.digest, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(words, 12)


def test_filter_grows_with_its_anchors(spark):
    assert repeats.filter_bits(0) == 18 and repeats.filter_bits(10 ** 6) == 25 and repeats.filter_bits(10 ** 9) is None
    kept = np.arange(3000, dtype=np.int64) * 7919 - 5_000_000
    table = np.frombuffer(repeats.bit_filter(spark.createDataFrame([(int(v),) for v in kept], "anchor long"), 18), np.int64)
    assert repeats.in_filter(table, kept).all() and repeats.in_filter(table, kept + 1).mean() < 0.02


def test_empty_tables(no_docs):
    assert substring.substring_dedup(no_docs).count() == 0
    assert suffix_array.suffix_dedup(no_docs).count() == 0
    assert jaccard_join.jaccard_links(no_docs).count() == 0
    assert jaccard_join.one_per_group(no_docs).columns == no_docs.columns


def test_removed_text_stays_valid(spark):
    shared = "é" * 40
    rows = [(1, "a" + shared + "b"), (2, "cc" + shared + "d"), (3, None)]
    out = dict(map(tuple, suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=39, anchor=9).collect()))
    assert out[3] is None and all(set(out[i]) <= set("aébcd") for i in (1, 2))
    assert len(out[1]) < len(shared)


def test_loser_tree_merges_with_shared_prefixes():
    draws = np.random.default_rng(2)
    runs = []
    for _ in range(5):
        strings = sorted(bytes(draws.integers(97, 99, draws.integers(0, 9)).tolist()) for _ in range(draws.integers(0, 30)))
        runs.append((strings, suffix_array.front_coded(strings)[0]))
        lcps, sizes, blob = suffix_array.front_coded(strings)
        assert suffix_array.decoded(lcps, sizes, blob) == strings
    order, common = suffix_array.merge_runs(runs)
    merged = [runs[r][0][i] for r, i in order]
    assert merged == sorted(itertools.chain.from_iterable(s for s, _ in runs))
    assert common[1:] == [suffix_array.shared(a, b, 0) for a, b in itertools.pairwise(merged)]


def brute_links(rows):
    sets = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words and doc is not None else set())
    near = defaultdict(set)
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            near[i].add(j)
            near[j].add(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        same = [rows[j][0] for j in reached if sets[j] == sets[i]]
        least = None if doc is None else min(rows[j][0] for j in reached)
        out.append((doc, None if doc is None else min(same), len(near[i]), least, doc is None or doc == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [None, 2])
def test_jaccard_links(odd_docs, odd_rows, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(jaccard_join, "BUCKET", blocks)
        monkeypatch.setattr(jaccard_join, "GROUP", blocks)
    got = jaccard_join.jaccard_links(odd_docs).drop("dkey").collect()
    assert sorted(map(tuple, got), key=str) == brute_links(odd_rows)


def test_one_per_group_keeps_columns_and_one_row(odd_docs, odd_rows):
    kept = jaccard_join.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted({str(r[0]) for r in brute_links(odd_rows) if r[4] and r[0] is not None} | set()) + ["None", "None"] or \
        Counter(ids) == Counter([str(r[0]) for r in brute_links(odd_rows) if r[4]])


def test_posterior_never_drops_a_likely_pair():
    least = jaccard_join.fewest_matches(0.8, 1e-7)
    assert list(least) == sorted(least) and all(m < 0.8 * n for n, m in least.items())


@pytest.mark.parametrize("block", [None, 3])
def test_embedding_links(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(embedding_join, "BLOCK", block)
    draws = np.random.default_rng(4)
    centre = draws.normal(size=(4, 6))
    rows = [(i, (centre[i % 4] + 0.12 * draws.normal(size=6)).tolist(), i) for i in range(40)]
    rows += [(100, rows[0][1], 1), (101, rows[0][1], 2), (101, rows[0][1], 2), (102, None, 1), (103, [0.0] * 6, 1),
             (104, [float("nan")] * 6, 1), (105, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (106, [1.0, 2.0], 1), (None, rows[0][1], 1), (107, [], 1)]
    got = embedding_join.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()
    fine = [i for i, (k, v, _) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = defaultdict(set)
    for i, j in itertools.combinations(fine, 2):
        a, b = rows[i][1], rows[j][1]
        if len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
            near[i].add(j)
            near[j].add(i)
    want = []
    for i, (k, _, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        least = None if k is None else min(rows[j][0] for j in reached)
        want.append((k, len(near[i]), least, k is not None and k == least))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(len(n) > 2 for n in near.values())
    assert embedding_join.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("block", [None, 5])
def test_links_across_cells(spark, monkeypatch, block):
    """Pairs whose two vectors have different pivots are found through the copies at the boundary."""
    if block:
        monkeypatch.setattr(embedding_join, "BLOCK", block)
    angles = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    x = np.stack((np.cos(angles), np.sin(angles), np.zeros(90)), 1)
    pivots = x[[0, 30, 60, 75]]
    monkeypatch.setattr(embedding_join, "fit_pivots", lambda *_: pivots)
    own, goes = embedding_join.cells_of(x, pivots, np.sqrt(0.1))
    assert len(set(own)) == 4 and len(x) < goes.sum() < 2 * len(x)
    rows = [(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.embedding_links(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = x @ x.T >= 0.95
    across = near & (own[:, None] != own[None])
    assert across.any() and got == {i: int(near[i].sum()) - 1 for i in range(90)}


def test_pivots_pay_where_vectors_lie_in_groups():
    draws = np.random.default_rng(8)
    x = np.repeat(np.eye(16), 40, axis=0) + 0.01 * draws.normal(size=(640, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(embedding_join.fit_pivots(x, 0.3, 10 ** 6)) >= 8
    assert len(embedding_join.fit_pivots(x[:1], 0.3, 10 ** 6)) == 1
