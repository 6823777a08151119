"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.langid import remainder

#: Labelled rows that the model is fitted on at most, those with the smallest hashes.
SAMPLE = 20_000
#: Preference pairs per document of the larger class, and the weight decay.
PAIRS, DECAY = 3, 1e-3
#: The score that stands for the quantile at which documents are taken for good.
CUT = 0.3

WORD_CLASSES = 8
NAMES = 33 + 4 + 10 + WORD_CLASSES


def features(text: str) -> np.ndarray:
    """Shape of a text: shares of characters, of kinds of words, and of repetition. No ids, no vocabulary."""
    raw = text.encode()
    out = np.zeros(NAMES)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    marks = np.concatenate((counts[33:48], counts[58:65], counts[91:97], counts[123:127], counts[127:128]))
    out[:33] = np.sqrt(marks / n)
    out[33:37] = np.sqrt(np.array([counts[65:91].sum(), counts[48:58].sum(), counts[128:].sum(), counts[10]]) / n)
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    own = out[37:47]
    own[0] = np.log1p(len(words))
    own[1] = lengths.mean()
    own[2] = lengths.std()
    own[3] = len(set(words)) / k
    own[4] = 1 - len(set(lines)) / len(lines)
    own[5] = np.log1p(n / len(lines))
    own[6] = sum(map(str.isupper, words)) / k
    own[7] = sum(map(str.istitle, words)) / k
    own[8] = sum(map(str.isalpha, words)) / k
    own[9] = sum(map(str.isdigit, words)) / k
    out[47:] = np.bincount(np.minimum(lengths // 3, WORD_CLASSES - 1), minlength=WORD_CLASSES) / k
    return out


def matrix(texts) -> np.ndarray:
    rows = [features(t or "") for t in texts]
    return np.stack(rows) if rows else np.zeros((0, NAMES))


@dataclass
class Ranker:
    """Weights over standardised features, and the line that turns a rank score into 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.rank(x) + self.shift, -40, 40)))


def preference_fit(better: np.ndarray, worse: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Weights ``w`` for which ``sum log(1 + exp(-w (better - worse)))`` is least, by Newton steps."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + decay * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + decay * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Rank by pairs of a good and a bad document; every document of the larger class is in ``PAIRS`` pairs.

    The quantile of scores that equals the share of bad documents gets the score ``CUT``;
    the slope is the logistic fit through that point. Without both classes nothing can be
    preferred and every document gets the share of good ones (or one half).
    """
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(NAMES), np.ones(NAMES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = np.clip(len(good) / len(y) if len(y) else 0.5, 0.01, 0.99)
        return Ranker(mean, scale, np.zeros(NAMES), 1.0, float(np.log(share / (1 - share))))
    z = np.clip((x - mean) / scale, -8, 8)
    draws = np.random.default_rng(5)
    n = PAIRS * max(len(good), len(bad))
    pair_good = np.resize(draws.permutation(np.resize(good, -(-n // len(good)) * len(good))), n)
    pair_bad = np.resize(draws.permutation(np.resize(bad, -(-n // len(bad)) * len(bad))), n)
    weights = preference_fit(z[pair_good], z[pair_bad])
    rank = z @ weights
    cut = float(np.quantile(rank, len(bad) / len(y)))
    base = np.log(CUT / (1 - CUT))
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * (rank - cut) + base, -30, 30)))
        grad = ((p - y) * (rank - cut)).mean()
        bend = (p * (1 - p) * (rank - cut) ** 2).mean() + 1e-9
        slope = float(np.clip(slope - grad / bend, 0.05, 50))
    return Ranker(mean, scale, weights, slope, float(base - slope * cut))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Fit on at most ``sample`` labelled documents outside the held-out part.

    Labelled ids are thinned by a hash before they meet the texts, so the join is with a
    bounded set; rows with a null id or label teach nothing, and a document with several
    labels counts with its smallest.
    """
    known = labels.filter((remainder("doc_id", 5) != 0) & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    right = bounded.withColumnRenamed("doc_id", "__labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(right), F.col("doc_id") == F.col("__labelled"))
    table = rows.select(vector()(F.col("text")).alias("x"), "quality", "doc_id").toArrow()
    y = table["quality"].to_numpy().astype(np.float64)
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(y), NAMES)
    order = np.lexsort((*x.T[:3], table["doc_id"].to_numpy()))
    return fit(x[order], y[order])


def vector():
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts)))

    return of


def scorer(model: Ranker):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)))

    return score


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


QUERIES = {"op5_quality": (op5_quality, None)}
