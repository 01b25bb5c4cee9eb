"""A quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Features are single tokens and pairs of tokens (runs of letters and digits, or of other marks), hashed into a fixed number of buckets. A pair of
equal tokens is hashed as a repeat, whatever the token, so that repetition is recognised in words never seen. A text's features are
its counts, scaled to length 1; its score is a sparse dot product through a logistic curve.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample

#: 2**BITS weights, 2 MB as 64-bit floats: what is broadcast has this size whatever the corpus.
BITS = 18
#: Labelled documents that the model is fitted on, at most, of either class.
SAMPLE_PER_CLASS = 2_000
#: The rates, penalties and passes of the updates.
ALPHA, BETA, L1, L2, EPOCHS = 0.4, 1.0, 1e-3, 1e-3, 4
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 200_000
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        raw = token.encode("utf-8", "surrogatepass")
        h = self[token] = zlib.crc32(raw) << 32 | zlib.adler32(raw)
        return h


def features(text: str | None, hashes: _Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text, values of length 1 as a vector; bucket 0 is kept for the bias and always 1."""
    h = np.fromiter(map(hashes.__getitem__, TOKEN.findall(text or "")), np.uint64)
    if not len(h):
        return np.zeros(1, np.int64), np.ones(1)
    pairs = np.where(h[1:] == h[:-1], _REPEAT, (h[:-1] * _MIX) ^ h[1:])
    both = np.concatenate([h, pairs]) * _MIX
    at = 1 + ((both >> np.uint64(64 - bits)).astype(np.int64)) % ((1 << bits) - 1)
    # Buckets come with their counts; the sort is over the text's own tokens.
    at, n = np.unique(at, return_counts=True)
    return np.concatenate([[0], at]), np.concatenate([[1.0], n / np.sqrt(float((n.astype(float) ** 2).sum()))])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader updates over (buckets, values, label) rows, in a seeded order each pass. No rows: all weights are 0."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            at, v, y = rows[i]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(1 << bits))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> np.ndarray:
    """Fits on labelled documents outside the held-out fold, at most per_class of either class (those whose ids hash lowest).

    Tasks make the features; what the driver gets is bounded by the sample. One class alone, or no label, gives the weights that such rows give.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            made = [features(t, hashes) for t in b.column(0).to_pylist()]
            at, v = pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(1), at, v], ["y", "at", "v"])

    sample = labelled_sample(docs, labels, "quality", per_class).limit(3 * per_class)
    table = sample.mapInArrow(make, "y int, at array<int>, v array<float>").toArrow()
    rows = [(at.values.to_numpy(), v.values.to_numpy(), y.as_py()) for y, at, v in zip(table["y"], table["at"], table["v"])]
    rows.sort(key=lambda r: (len(r[0]), r[2], zlib.crc32(r[0].tobytes())))  # an order that doesn't hang on the tasks'
    return fit_ftrl(rows)


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """({id_col}, score): a row for each row of docs. A null or empty text has the bias alone. Repeated rows and null ids stay; other columns aren't returned."""
    return docs.select(id_col, quality_column(docs, weights, F.col(text_col)).alias("score"))


def quality_column(docs: DataFrame, weights: np.ndarray, text: Column) -> Column:
    """The score of a text, as score_quality() has it."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, w = _Hashes(), sent.value
        for f in frames:
            dots = np.fromiter((w[at] @ v for at, v in (features(t, hashes) for t in f)), float, len(f))
            yield pd.Series(1 / (1 + np.exp(-np.clip(dots, -30, 30))))

    return score(F.coalesce(text, F.lit("")))


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of score_quality() that op10_quality returns; held_out is null for a null id."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
