"""Language identification with bit-sliced n-gram filters.

One Bloom filter is shared by all languages: each of its cells holds a bit per language.
Looking an n-gram up means an ``and`` of the cells its hashes name, and gives all
languages that contain it at once. A text's n-grams are counted per language, and each
count is corrected for the share of cells that language has filled.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.windows import mixed
from riskloom.session import materialize

#: Characters per n-gram.
GRAMS = (2, 3, 4)
#: An n-gram belongs to a language if it makes up this share of the language's n-grams ...
LEAST_RATE = 2e-6
#: ... and at least this part of the share it has where it is most frequent.
LEAST_PART = 0.05
#: Cells of the filter (a power of two) and hashes per n-gram: 8 MB for each 64 languages.
CELLS, HASHES = 1 << 20, 2
#: Characters worked on at once.
CHUNK = 1_000_000

_letters = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, number of them per text).

    Case is folded, every stretch without letters counts as one space, and a text is
    framed by spaces, so n-grams know where words begin and end. A text without a
    letter has none.
    """
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = points == 0
    letter = letter_table()[points]
    owner = np.cumsum(cut) - cut  # the mark that closes a text is its last place
    # a space after each run of letters, and one before each text's first
    kept = np.where(letter, points, 32)
    before = np.concatenate(([False], letter[:-1]))
    keep = letter | (before & ~letter)
    points, owner = kept[keep], owner[keep]
    if len(points) and points[-1] != 32:
        points, owner = np.append(points, 32), np.append(owner, owner[-1])
    new = np.ones(len(points), bool)
    new[1:] = owner[1:] != owner[:-1]
    at = np.flatnonzero(new)
    points, owner = np.insert(points, at, 32).astype(np.uint64), np.insert(owner, at, owner[at])
    hashes, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        code = np.full(len(points) - n + 1, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[i:len(points) - n + 1 + i]
        inside = owner[n - 1:] == owner[:len(code)]
        hashes.append(mixed(code[inside]))
        owners.append(owner[:len(code)][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    of = np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(of, minlength=len(texts))


def chunks(texts):
    """(first row, texts) with about ``CHUNK`` characters each."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, lang, times) over (text, lang), summed per chunk before the exchange."""

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in chunks(batch.column(0).to_pylist()):
                grams, sizes = gram_codes(texts)
                own = np.array(langs[first:first + len(texts)])
                of = np.repeat(own, sizes)
                for lang in np.unique(own):
                    found, times = np.unique(grams[of == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array([str(lang)] * len(found)), pa.array(times)],
                        names=["gram", "lang", "times"])

    return docs.mapInArrow(count, "gram long, lang string, times long").groupBy("gram", "lang").agg(
        F.sum("times").alias("times"))


def cells_of(gram: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(64 - (CELLS.bit_length() - 1))
    odd = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
    return [((gram * np.uint64(odd[i])) >> bits).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    """Languages, cells (one plane per 64 languages) and each language's share of false hits."""

    languages: list[str]
    planes: np.ndarray
    false_rate: np.ndarray


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fill the filter from all texts with a language; rows with a null one teach nothing."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = materialize(gram_counts(rows.filter("lang is not null")), "grams")
    total = counts.groupBy("lang").agg(F.sum("times").alias("total"))
    rates = counts.join(F.broadcast(total), "lang").select("gram", "lang", (F.col("times") / F.col("total")).alias("rate"))
    languages = sorted(r["lang"] for r in total.select("lang").collect())
    cells = np.zeros((max(1, -(-len(languages) // 64)), CELLS), np.uint64)
    if languages:
        number = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
        top = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("all"))
        kept = top.select("gram", "top", F.inline("all")).filter(
            (F.col("rate") >= LEAST_RATE) & (F.col("rate") >= LEAST_PART * F.col("top")))
        kept = kept.select("gram", number[F.col("lang")].alias("number"))

        def place(batches):
            for batch in batches:
                gram, which = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                for cell in cells_of(gram):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((which // 64).astype(np.int32)), pa.array(cell),
                         pa.array((np.uint64(1) << (which % 64).astype(np.uint64)).view(np.int64))],
                        names=["plane", "cell", "bits"])

        filled = kept.mapInArrow(place, "plane int, cell long, bits long").groupBy("plane", "cell").agg(
            F.bit_or("bits").alias("bits"))
        # at most CELLS rows per plane, whatever the corpus
        table = filled.toArrow()
        cells[table["plane"].to_numpy(), table["cell"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    full = np.array([((cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, cells, full ** HASHES)


def popcounts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams per text, texts x languages corrected shares of n-grams that the language contains)."""
    grams, sizes = gram_codes(texts)
    shares = np.zeros((len(texts), len(model.languages)))
    some = np.flatnonzero(sizes)
    if len(some) and model.languages:
        starts = (np.cumsum(sizes) - sizes)[some]
        cells = cells_of(grams)
        for p, plane in enumerate(model.planes):
            mask = plane[cells[0]]
            for cell in cells[1:]:
                mask &= plane[cell]
            for i in range(64 * p, min(64 * p + 64, len(model.languages))):
                bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
                shares[some, i] = np.add.reduceat(bit, starts) / sizes[some]
        wrong = np.minimum(model.false_rate, 0.999)
        shares = np.clip((shares - wrong) / (1 - wrong), 0, 1)
        shares[sizes == 0] = 0
    return sizes, shares


def language_of(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang_pred, score).

    ``lang_pred`` is the language with the largest corrected share, the first by name
    among equals; ``und`` with score 0 for a null text, one without a letter, or a model
    without languages. ``score`` is that share.
    """
    sent = spark.sparkContext.broadcast((model.languages, model.planes, model.false_rate))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        languages, planes, wrong = sent.value
        known = Model(languages, planes, wrong)
        preds, scores = [], []
        for _, part in chunks(texts.tolist()):
            sizes, shares = popcounts(known, part)
            best = shares.argmax(1) if languages else np.zeros(len(part), np.int64)
            for n, i, row in zip(sizes.tolist(), best.tolist(), shares):
                preds.append(languages[i] if n and languages else "und")
                scores.append(float(row[i]) if n and languages else 0.0)
        return pd.DataFrame({"lang_pred": preds, "score": scores})

    return predict


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose id does not fall into the held-out part; rows without an id teach nothing."""
    return docs.filter(remainder("doc_id", 4) != 2)


def identify(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with a struct ``__language`` of lang_pred and score."""
    model = model or learn(training_rows(docs))
    return docs.withColumn("__language", language_of(docs.sparkSession, model)(F.col(text_col)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "__language.lang_pred",
        "__language.score")


QUERIES = {"op4_language_id": (op4_language_id, None)}
