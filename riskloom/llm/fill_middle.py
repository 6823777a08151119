"""Fill-in-the-middle documents, cut at line ends through a learned rank index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that a prediction may be off, before the residual mends it.
ERROR = 64
#: Code points that are searched for line ends at a time.
CHUNK = 1 << 20
#: Characters of output that are sent back at a time, about.
SEND = 4 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, segments int, output string"


@dataclass(frozen=True)
class RankIndex:
    """Offsets by rank: piecewise-linear predictions, and what each one is off."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, rank: np.ndarray) -> np.ndarray:
        """The offsets of these ranks as the segments have them, off by ``error`` and a half at most."""
        at = np.searchsorted(self.first, rank, "right") - 1
        return self.base[at] + np.rint(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of these ranks."""
        return self.predict(rank) + self.residual[rank]


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Segments whose lines pass within ``error`` of every offset, as long as a cone allows.

    A segment starts at a point. Each later point narrows the cone of slopes that still
    pass all points; the one that empties it starts the next segment.
    """
    first, slopes, at, end = [], [], 0, len(offsets)
    while at < end:
        reach, stop, slope = 64, at + 1, 0.0
        while at + 1 < end:
            run = np.arange(1, min(reach, end - at - 1) + 1)
            rise = offsets[at + 1:at + 1 + len(run)] - offsets[at]
            low = np.maximum.accumulate((rise - error) / run)
            high = np.minimum.accumulate((rise + error) / run)
            empty = np.flatnonzero(low > high)
            kept = int(empty[0]) if len(empty) else len(run)
            if not len(empty) and at + 1 + kept < end:
                reach *= 4
                continue
            if kept:
                stop, slope = at + 1 + kept, (low[kept - 1] + high[kept - 1]) / 2
            break
        first.append(at)
        slopes.append(slope)
        at = stop
    starts = np.array(first, np.int64)
    bare = RankIndex(starts, offsets[starts], np.array(slopes), np.zeros(end, np.int8))
    residual = offsets - bare.predict(np.arange(end))
    return RankIndex(bare.first, bare.base, bare.slope, residual.astype(np.min_scalar_type(-error - 2)))


def line_ends(text: str) -> np.ndarray:
    """Offset 0 and the end of every line, in code points; the last line may lack its line feed."""
    found = [np.zeros(1, np.int64)]
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le"), "<u4")
        found.append(np.flatnonzero(points == 10) + (at + 1))
    if text and not text.endswith("\n"):
        found.append(np.array([len(text)], np.int64))
    return np.concatenate(found)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of a document, from the hash of seed and id; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def rearrange(doc_id: int | None, text: str, seed: int, rate: int, spm: int, error: int) -> tuple:
    """One row of ``SCHEMA``."""
    index = fit(line_ends(text), error)
    n = len(index.residual) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, len(index.first), text
    ranks = np.array(sorted((h1 % (n + 1), h2 % (n + 1))))
    start, stop = index.offset(ranks).tolist()
    head, middle, tail = text[:start], text[start:stop], text[stop:]
    if h4 % 100 < spm:
        form, out = "spm", [SUFFIX, tail, PREFIX, head, MIDDLE, middle]
    else:
        form, out = "psm", [PREFIX, head, SUFFIX, tail, MIDDLE, middle]
    return doc_id, n, form, len(head), len(middle), len(index.first), "".join(out)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
              spm: int = 50, error: int = ERROR) -> DataFrame:
    """Cut every text into prefix, middle and suffix at two line ends, and put them in order.

    ``n`` counts lines, each with its line feed. ``rate`` of 100 texts are rearranged, ``spm`` of
    100 of these have the suffix first. A null text is empty; an empty text, one that holds a
    marker and one outside the rate stay as they are (form ``plain``, no lengths). A null id
    draws as the empty id. Repeated rows come out as often as they go in, alike. A text of any length
    is handled whole by the task that reads it; nothing is shuffled. Other columns are ignored.
    ``segments`` is the number of lines in the index.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.large_string())
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "segments", "output"]

        def send(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append(rearrange(doc_id, text.as_py() or "", seed, rate, spm, error))
                held += len(rows[-1][-1])
                if held > SEND:
                    yield send(rows)
                    rows, held = [], 0
            yield send(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, SCHEMA)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text again, from form and output alone; no text that was cut holds a marker."""
    out = F.col(output)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        second_at, third_at = F.locate(second, out), F.locate(MIDDLE, out)
        start = F.lit(len(first) + 1)
        return (F.substring(out, start, second_at - start),
                F.substring(out, second_at + len(second), third_at - second_at - len(second)),
                F.substring(out, third_at + len(MIDDLE), F.length(out)))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    other_suffix, other_prefix, other_middle = parts(SUFFIX, PREFIX)
    return (F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
            .when(F.col(form) == "spm", F.concat(other_prefix, other_middle, other_suffix)).otherwise(out))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u from documents),
r as (select *, len(u) n, cast('0x' || h[1:8] as bigint) h1, cast('0x' || h[9:16] as bigint) h2,
      cast('0x' || h[25:32] as bigint) h4,
      t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') plain from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b from r),
p as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:n], '') suf,
      case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from c)
select doc_id, cast(n as bigint) n, form, case when not plain then cast(length(pre) as bigint) end prefix_chars,
       case when not plain then cast(length(mid) as bigint) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256
from p
"""
QUERIES = {"op12_fill_middle": (op12_fill_middle, SQL)}
