"""Text encoding with any encoder the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """One float vector per text."""


def embed_text(
    df: DataFrame,
    text: str,
    encoder_factory: Callable[[], Encoder],
    batch_size: int = C.ENCODER_BATCH,
    output: str = "embedding",
) -> DataFrame:
    """Add the vector of ``text``. The factory runs once per task, so a model loads once."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_factory()
        for texts in batches:
            vectors: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                chunk = texts.iloc[start:start + batch_size].fillna("").tolist()
                vectors.extend(np.asarray(encoder.encode(chunk), dtype=np.float32))
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return df.withColumn(output, encode(F.col(text)))


class LetterCounts:
    """A plain encoder: how often each of the 26 letters occurs, in either case."""

    letters = "abcdefghijklmnopqrstuvwxyz"

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array(
            [[t.count(c) + t.count(c.upper()) for c in self.letters] for t in texts],
            dtype=np.float32,
        ).reshape(len(texts), len(self.letters))
