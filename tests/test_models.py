"""Models against plain numpy."""

import datetime as dt
import itertools
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.operators.anomaly import fit_user_stats, score_anomaly
from riskloom.operators.bandit import (
    Policy, bandit_replay, fit_scaler, policy_grid, scale_context,
)
from riskloom.operators import bandit, semantic
from riskloom.operators.reduction import causal_pca
from riskloom.functions.vectors import packed, unpacked
from riskloom.operators.semantic import semantic_deviation, vector_dims
from riskloom.plans import fixtures as fx
from riskloom.plans import policy_queries


# --- semantic deviation -----------------------------------------------------
def events(users=4, n=120, dims=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.6 else f"u{rng.integers(users)}"
        vector = np.zeros(dims) if i % 17 == 0 else rng.normal(size=dims)
        rows.append((i, i // 3, user, [float(np.float32(v)) for v in vector]))
    rows.append((n, n, "once", [1.0] * dims))
    return rows


SCHEMA = "seq bigint, ts bigint, user string, embedding array<float>"


def brute_deviation(rows):
    total, out = {}, {}
    for seq, ts, user, vector in sorted(rows, key=lambda r: (r[1], r[0])):
        v = np.array(vector)
        past = total.get(user)
        if past is None or not np.linalg.norm(v) or not np.linalg.norm(past):
            out[seq] = None
        else:
            out[seq] = 1 - v @ past / np.linalg.norm(v) / np.linalg.norm(past)
        total[user] = v if past is None else past + v
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert (got[key] is None) == (value is None), key
        if value is not None:
            assert got[key] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("max_window_dims", [0, 16])
@pytest.mark.parametrize("rows_per_task", [10, 10**6])
def test_deviation_forms_agree(spark, max_window_dims, rows_per_task):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = semantic_deviation(df, rows_per_task=rows_per_task, max_window_dims=max_window_dims)
    same({r["seq"]: r["semantic_deviation"] for r in got.collect()}, brute_deviation(rows))


@pytest.mark.parametrize("max_window_dims", [0, 16])
@pytest.mark.parametrize("rows_per_task", [10, 10**6])
def test_vectors_that_cannot_be_used(spark, max_window_dims, rows_per_task):
    odd = [None, [1.0] * 4, [None] + [1.0] * 4, [float("nan")] * 5]
    rows = [(s, t, u, odd[s // 7 % 4] if s % 7 == 0 else v) for s, t, u, v in events()]
    rows += [(1000 + i, i, "never", odd[i % 4]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = semantic_deviation(df, dims=5, rows_per_task=rows_per_task, max_window_dims=max_window_dims)
    want = brute_deviation([(s, t, u, [0.0] * 5 if v in odd else v) for s, t, u, v in rows])
    assert got.columns == [*df.columns, "semantic_deviation"]
    same({r["seq"]: r["semantic_deviation"] for r in got.collect()}, want)


@pytest.mark.parametrize("rows_per_task", [10, 10**6])
def test_packed_vectors_are_the_same_vectors(spark, rows_per_task):
    """Odd ones included, for users that are cut too; what comes out is packed still."""
    odd = [None, [1.0] * 4, [None] + [1.0] * 4, [float("nan")] * 5, [], [float("inf")] + [1.0] * 4]
    rows = [(s, t, u, odd[s // 7 % 5] if s % 7 == 0 else v) for s, t, u, v in events()] + [(1000, 1000, "once", odd[5])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tight = packed(df, "embedding")
    assert dict(tight.dtypes)["embedding"] == "binary" and vector_dims(tight.filter("seq = 1"), "embedding") == 5

    def known(frame):
        return {r["seq"]: repr(r["embedding"]).replace("None, ", "nan, ") for r in frame.collect()}

    assert known(unpacked(tight, "embedding")) == known(df)
    want = semantic_deviation(df, dims=5, rows_per_task=rows_per_task)
    for max_window_dims in (0, 16):
        got = semantic_deviation(tight, dims=5, rows_per_task=rows_per_task, max_window_dims=max_window_dims)
        assert got.schema["embedding"] == tight.schema["embedding"]
        same(*({r["seq"]: r["semantic_deviation"] for r in d.filter("seq < 1000").collect()} for d in (got, want)))
    fits = [fit_scaler(d.withColumn("hour_of_day", F.col("ts")), ["hour_of_day"], vector="embedding", dims=5) for d in (df, tight)]
    assert np.allclose(fits[0].vector_mean, fits[1].vector_mean) and np.allclose(fits[0].vector_std, fits[1].vector_std)


def test_features_move_packed_vectors_and_make_the_log_once(spark, sf, monkeypatch):
    """Bytes go through the shuffle, the sort and the file, and no count of the users joins the vectors first."""
    plans, write = [], fx.materialize

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *args, **options)

    monkeypatch.setattr(fx, "materialize", seen)
    cut, known = semantic.ordered_slots, []
    monkeypatch.setattr(semantic, "ordered_slots", lambda *args: known.append(args[4:]) or cut(*args))
    feats = fx.features(spark, sf, vector=True)
    assert known == [(fx.busiest(spark, sf),)]
    assert dict(feats.dtypes)["embedding"] == "binary"
    assert plans[0].count("MapInArrow") == 2 and plans[0].count("Join") == 1
    assert fx.busiest(spark, sf) == feats.groupBy("user").count().agg(F.max("count")).first()[0]
    log = {r["id"]: r["embedding"] for r in fx.activity(spark, sf, embedding=True).collect()}
    assert {r["id"]: r["embedding"] for r in unpacked(feats, "embedding").collect()} == log


def test_deviation_is_causal(spark):
    rows = events()
    changed = [(s, t, u, [9.0] * 5 if s > 60 else v) for s, t, u, v in rows]
    parts = []
    for data in (rows, changed):
        got = semantic_deviation(spark.createDataFrame(data, SCHEMA), max_window_dims=0)
        parts.append({r["seq"]: r["semantic_deviation"] for r in got.collect() if r["seq"] <= 60})
    assert parts[0] == parts[1]


# --- causal components ------------------------------------------------------
def test_causal_pca_against_numpy(spark):
    rng = np.random.default_rng(5)
    sizes, k, dims = [30, 2, 40, 25], 3, 6
    rows, i = [], 0
    for batch, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, batch, [float(v) for v in rng.normal(size=dims) * np.arange(1, dims + 1)]))
            i += 1
    df = spark.createDataFrame(rows, "id int, batch int, e array<double>").repartition(4)
    want = {}
    for batch in range(len(sizes)):
        past = np.array([v for _, b, v in rows if b < batch and sizes[b] >= k])
        for id_, b, v in rows:
            if b == batch:
                if len(past) == 0:
                    want[id_] = None
                    continue
                mean = past.mean(axis=0)
                values, vectors = np.linalg.eigh(np.cov(past.T, bias=True))
                top = vectors[:, ::-1][:, :k].T
                top = top * np.sign(top[np.arange(k), np.abs(top).argmax(axis=1)])[:, None]
                want[id_] = top @ (np.array(v) - mean)
    for per_block, per_group in ((256, 50_000), (2, 50_000), (1, 3)):
        rows = causal_pca(df, "batch", "e", k, per_block=per_block, rows_per_group=per_group).collect()
        got = {r["id"]: r["embed_pc"] for r in rows}
        assert len(rows) == len(got)
        assert got.keys() == want.keys()
        for id_, value in want.items():
            if value is None:
                assert got[id_] is None
            else:
                assert np.allclose(got[id_], value, atol=1e-8)


# --- static scores ----------------------------------------------------------
FEATURES = [*C.NUMERIC_FEATURES, *C.RARITY_FEATURES]
FEATURE_SCHEMA = "id int, user string, is_malicious int, " + ", ".join(f"{c} double" for c in FEATURES)


def feature_rows(n, seed, users=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        user = users[i % len(users)]
        values = [*(float(v) for v in rng.exponential(50, 4)), float(rng.random()), *(float(v) for v in rng.integers(0, 2, 3))]
        if i % 11 == 0:
            values[0] = None
        if i % 13 == 0:
            values[4] = float("nan")
        rows.append((i, user, 0, *values))
    return rows


def brute_scores(train, test):
    def matrix(rows):
        out = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows], dtype=float)
        out[:, :4] = np.log1p(out[:, :4])
        return out

    def stats(x):
        n = np.isfinite(x).sum(axis=0)
        with np.errstate(all="ignore"):
            return n, np.nanmean(x, axis=0), np.nanvar(x, axis=0)

    every = stats(matrix(train))
    out = {}
    for row in test:
        own = [r for r in train if r[1] == row[1]]
        n, mean, var = stats(matrix(own)) if own else every
        thin = not own or (n[:5] < 30).any()
        rare = not own or (n[5:] < 30).any()
        mean_n, var_n = (every[1], every[2]) if thin else (mean, var)
        rate = (every[1] if rare else mean)[5:]
        x = matrix([row])[0]
        valid = np.isfinite(x[:5])
        z = np.minimum(np.abs((x[:5] - mean_n[:5]) / np.sqrt(np.maximum(var_n[:5], 1e-3))), 6)
        numeric = z[valid].mean() if valid.any() else 0.0
        rarity = (np.nan_to_num(x[5:]) * -np.log(np.maximum(rate, 1e-3))).sum()
        out[row[0]] = (numeric, rarity, numeric + 0.5 * rarity, int(thin))
    return out


def test_static_scores_against_numpy(spark):
    train = feature_rows(150, 1) + [(900 + i, "thin", 0, *r[3:]) for i, r in enumerate(feature_rows(10, 2))]
    test = feature_rows(40, 3, ("a", "b", "thin", "new"))
    test.append((999, "a", 0, *[None] * len(FEATURES)))
    stats = fit_user_stats(spark.createDataFrame(train, FEATURE_SCHEMA))
    got = score_anomaly(spark.createDataFrame(test, FEATURE_SCHEMA), stats, keep=("id",))
    got = {r["id"]: tuple(r)[1:] for r in got.collect()}
    want = brute_scores(train, test)
    assert got.keys() == want.keys()
    for id_ in want:
        assert got[id_] == pytest.approx(want[id_], abs=1e-9)


def test_fit_needs_rows_and_values(spark):
    df = spark.createDataFrame(feature_rows(40, 1), FEATURE_SCHEMA)
    with pytest.raises(ValueError, match="no training rows"):
        fit_user_stats(df.limit(0))
    with pytest.raises(ValueError, match="semantic_deviation"):
        fit_user_stats(df.withColumn("semantic_deviation", F.lit(None).cast("double")))


# --- bandit -----------------------------------------------------------------
CONTEXT_SCHEMA = "id int, seq int, user string, is_malicious int, day date, x array<double>"


def contexts(days=4, n=60, dims=4, seed=7, flip=()):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        for _ in range(n + 7 * d):
            x = [1.0, *(float(v) for v in rng.normal(size=dims - 1))]
            bad = int(x[1] > 1.2)
            i = len(rows)
            rows.append((i, i, "u", 1 - bad if i in flip else bad, day, x))
    return rows


def model_of(seen, d, ridge=1.0):
    """A and b of all rows reviewed so far, given as (x, reward)."""
    x, reward = np.array([x for x, _ in seen]).reshape(-1, d), np.array([r for _, r in seen])
    return ridge * np.eye(d) + x.T @ x, x.T @ reward


def bounds(seen, x, alpha):
    """Upper confidence bounds: a ridge regression on ``seen``, and the length of L^-1 x where A is L LT."""
    a, b = model_of(seen, x.shape[1])
    lower = np.linalg.cholesky(a)
    return x @ np.linalg.solve(a, b) + alpha * np.sqrt((np.linalg.solve(lower, x.T) ** 2).sum(axis=0))


def brute_replay(rows, policy, budget):
    """Every day's model is fitted anew on all that was reviewed before."""
    seen, queue, daily = [], {}, {}
    for day, part in itertools.groupby(sorted(rows, key=lambda r: r[4]), key=lambda r: r[4]):
        part = list(part)
        scores = bounds(seen, np.array([r[5] for r in part]), policy.alpha)
        quota = max(1, math.ceil(len(part) * budget))
        best = sorted(zip(-np.round(scores, 9), (r[1] for r in part), scores, part), key=lambda b: b[:2])[:quota]
        queue.update({row[0]: score for _, _, score, row in best})
        rewards = [policy.reward if row[3] else -policy.cost for *_, row in best]
        seen += [(row[5], reward) for (*_, row), reward in zip(best, rewards)]
        daily[day] = (len(part), quota, sum(row[3] for *_, row in best), min(quota, sum(r[3] for r in part)), sum(rewards))
    return queue, daily, *model_of(seen, len(rows[0][5])), seen


@pytest.mark.parametrize("rows_per_task", [20, 10**6])
def test_replay_against_row_updates(spark, rows_per_task):
    rows = contexts(days=3 if rows_per_task == 20 else 4)
    policies = [Policy("p", 0.5, 10.0), Policy("q", 2.0, 100.0)]
    df = spark.createDataFrame(rows, CONTEXT_SCHEMA).repartition(4)
    replay = bandit_replay(df, policies, 0.1, rows_per_task=rows_per_task)
    daily = replay.daily.collect()
    for policy in policies:
        queue, want, a, b, _ = brute_replay(rows, policy, 0.1)
        got = {r["id"]: r["ucb_score"] for r in replay.queue.filter(F.col("policy") == policy.name).collect()}
        same(got, queue)
        series = {
            r["day"]: (r["emails"], r["reviewed"], r["true_positives"], r["oracle_true_positives"], r["reward"])
            for r in daily if r["policy"] == policy.name
        }
        assert series == want
        model = replay.state.models[policy.name]
        assert np.allclose(model.a, a, atol=1e-9) and np.allclose(model.b, b)


@pytest.mark.parametrize("short", [False, True])
def test_contexts_of_a_large_day_stay_behind(spark, monkeypatch, short):
    """Only candidates carry their contexts to the selection; where they should be too few, the scores alone do."""
    rows = contexts(days=2, n=3000)
    policies = [Policy("p", 0.5, budget=0.02), Policy("q", 2.0, 100.0, budget=0.1)]
    sizes, review = [], bandit.review_day

    def counted(scored, *args):
        sizes.append((scored.count(), "x" in scored.columns))
        return review(scored, *args)

    monkeypatch.setattr(bandit, "SMALL_DAY", 1000, raising=False)
    monkeypatch.setattr(bandit, "review_day", counted)
    if short:
        monkeypatch.setattr(bandit, "day_candidates", lambda *args: None)
    replay = bandit_replay(spark.createDataFrame(rows, CONTEXT_SCHEMA).repartition(4), policies)
    assert sizes == [(6000, False), (6014, False)] if short else all(x and n < 0.13 * 3010 for n, x in sizes)
    for policy in policies:
        queue = brute_replay(rows, policy, policy.budget)[0]
        same({r["id"]: r["ucb_score"] for r in replay.queue.filter(F.col("policy") == policy.name).collect()}, queue)


@pytest.mark.parametrize("small_day", [10, 10**6])
def test_ties_and_contexts_that_are_no_numbers(spark, monkeypatch, small_day):
    """Equal scores go by place in the log, and a score that is no number comes last on days of any size."""
    monkeypatch.setattr(bandit, "SMALL_DAY", small_day, raising=False)
    day = dt.date(2024, 1, 1)
    odd = {3, 8, 11}
    rows = [(i, i, "u", 0, day, [1.0, float("nan") if i in odd else float(i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, CONTEXT_SCHEMA).repartition(3)
    ones = [i for i in range(40) if i % 2 and i not in odd]
    zeros = [i for i in range(40) if i % 2 == 0 and i not in odd]
    for quota in (5, 30, 39):
        got = bandit_replay(df, budget=quota / 40).queue.select("id").collect()
        assert sorted(r["id"] for r in got) == sorted((ones + zeros + sorted(odd))[:quota])


def test_replay_never_sees_unreviewed_labels(spark):
    rows = contexts()
    queue, *_ = brute_replay(rows, Policy(), 0.1)
    flipped = contexts(flip={r[0] for r in rows if r[0] not in queue})
    df = spark.createDataFrame(flipped, CONTEXT_SCHEMA)
    got = {r["id"] for r in bandit_replay(df, budget=0.1).queue.select("id").collect()}
    assert got == set(queue)


def test_scaler_imputes_the_mean(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "hour_of_day double")
    scaler = fit_scaler(train, ["hour_of_day"])
    assert (scaler.n_train, scaler.mean, scaler.std) == (3, (2.0,), (1.0,))
    rows = scale_context(train, scaler, []).collect()
    assert [r["x"] for r in rows] == [[1.0, -1.0], [1.0, 1.0], [1.0, 0.0]]
    with pytest.raises(ValueError):
        fit_scaler(train.limit(0), ["hour_of_day"])


def test_policies_have_budgets_of_their_own(spark):
    rows = contexts(days=3)
    arms = [Policy("small", budget=0.02), Policy("large", 0.5, 100.0, budget=0.3), Policy("plain")]
    df = spark.createDataFrame(rows, CONTEXT_SCHEMA)
    for rows_per_task in (25, 10**6):
        replay = bandit_replay(df, arms, 0.1, rows_per_task=rows_per_task)
        for arm in arms:
            want = brute_replay(rows, arm, arm.budget or 0.1)[0]
            same({r["id"]: r["ucb_score"] for r in replay.queue.filter(F.col("policy") == arm.name).collect()}, want)
    with pytest.raises(ValueError):
        bandit_replay(df, [Policy("none", budget=0.0)])


def test_scaler_of_a_vector(spark):
    rows = [([1.0, 2.0, float("nan")],), ([3.0, None, 5.0],), ([5.0],), (None,), ([float("inf"), 4.0, 5.0, 9.0],)]
    df = spark.createDataFrame([(1.0, *r) for r in rows], "hour_of_day double, v array<float>")
    scaler = fit_scaler(df, ["hour_of_day"], vector="v", dims=3)
    assert (scaler.n_train, scaler.vector_mean) == (5, (3.0, 3.0, 5.0))
    assert np.allclose(scaler.vector_std, [math.sqrt(8 / 3), 1.0, 1e-3])
    got = [r["x"][2:] for r in scale_context(df, scaler, []).collect()]
    step = 2 / math.sqrt(8 / 3)
    assert np.allclose(got, [[-step, -1, 0], [0, 0, 0], [step, 0, 0], [0, 0, 0], [0, 1, 0]])
    with pytest.raises(ValueError):
        fit_scaler(df, ["hour_of_day"], vector="v", dims=5)


def test_contexts_are_arranged_before_they_are_scaled(spark, monkeypatch, sf="/root/testdata/sf0.01"):
    """The shuffle by day carries vectors as they came, and a day's file is several tasks' work."""
    plans, write = [], policy_queries.materialize

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *args, **options)

    monkeypatch.setattr(policy_queries, "materialize", seen)
    monkeypatch.setattr(policy_queries, "CONTEXT_ROW_GROUP", 1 << 14, raising=False)
    written = policy_queries._written_contexts(spark, sf)
    assert 0 <= plans[0].find("MapInArrow") < plans[0].find("RebalancePartitions")
    files = written.inputFiles()
    days = {re.search("day=([0-9-]+)", f)[1] for f in files}
    assert len(files) == len(days) > 2
    assert min(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in files) > 1
    plain = {r["id"]: r["x"] for r in fx.contexts(spark, sf).collect()}
    same({r["id"]: r["x"] for r in written.collect()}, plain)


def test_policy_grid_is_the_published_one():
    assert [(p.name, p.alpha, p.reward) for p in policy_grid()] == C.POLICY_GRID


def test_scores_of_all_days_against_row_updates(spark, sf):
    columns = ("id", "seq", "user", "is_malicious", "day", "x")
    written = policy_queries._written_contexts(spark, sf)
    rows = sorted((tuple(r[c] for c in columns) for r in written.collect()), key=lambda r: r[1])
    got = {r["id"]: r["ucb_score"] for r in policy_queries.bandit_scores(spark, sf).collect()}
    days = sorted({r[4] for r in rows})
    assert len(days) > 2 and got.keys() == {r[0] for r in rows}
    for day in days:
        past, now = [r for r in rows if r[4] < day], [r for r in rows if r[4] == day]
        seen = brute_replay(past, Policy(), policy_queries.REPLAY_BUDGET)[4] if past else []
        want = bounds(seen, np.array([r[5] for r in now]), 1.0)
        assert np.allclose([got[r[0]] for r in now], want, atol=2e-5)


def test_grid_has_every_scenario(spark, sf, monkeypatch):
    real = fx.label_rows(spark, sf)
    moved = real.withColumn("scenario", F.col("scenario") + 5).filter("scenario <> 8")
    monkeypatch.setattr(fx, "label_rows", lambda *_: moved)
    monkeypatch.setattr(policy_queries, "REPLAY_BUDGET", 0.5)
    rows = policy_queries.policy_grid(spark, sf).collect()
    labelled = {r["scenario"] for r in moved.collect()}
    assert {7, 9} == labelled
    for policy in policy_grid():
        mine = {r["scenario"]: r for r in rows if r["policy"] == policy.name}
        # what has lost its label is scenario 0
        assert labelled <= set(mine) <= {0, *labelled}
        assert sum(r["scenario_true_positives"] for r in mine.values()) == next(iter(mine.values()))["true_positives"] > 0
