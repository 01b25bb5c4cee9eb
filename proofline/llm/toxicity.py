"""Toxicity by maximum-scoring segments of token log-odds.

A token's weight is the log-odds of standing in a toxic against a clean document. Its Dirichlet prior is what the tokens of the same beginning
(five characters) show, and theirs is even odds, so that a form of a word that was never seen is judged by its kin. Weights that chance explains are 0.
Less a drift, so that clean text scores below 0 on average, the weights of a document's tokens form a sequence whose every maximal-scoring segment is found in
one linear scan. Segments are judged by the extreme-value law of such maxima: a segment of score S in n tokens is expected
K n exp(-lambda S) times by chance. A document's evidence is the sum of lambda S - ln(K n) over its segments that chance doesn't explain, and
a logistic curve makes it a score from 0 to 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, labelled_sample, settle

#: Tokens are counted in 2**TOKEN_BITS buckets, beginnings in 2**KIN_BITS: what is broadcast has a fixed size, whatever the corpus.
TOKEN_BITS, KIN_BITS, KIN_CHARS = 18, 16, 5
#: Labelled documents that the model is fitted on, at most, of either class.
SAMPLE_PER_CLASS = 6_000
#: Documents that the priors count as, of a token and of a beginning.
TOKEN_PRIOR, KIN_PRIOR = 1.0, 1.0
DRIFT = 0.5
TOKEN = re.compile(r"\w+")
#: A worker forgets its tokens' buckets beyond so many.
CACHE = 200_000


class _Buckets(dict):
    """Token -> its bucket and its beginning's, in one number; remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        own = zlib.crc32(token.encode("utf-8", "surrogatepass")) & (1 << TOKEN_BITS) - 1
        kin = zlib.crc32(token[:KIN_CHARS].encode("utf-8", "surrogatepass")) >> 32 - KIN_BITS
        at = self[token] = own << KIN_BITS | kin
        return at


def token_ids(text: str | None, buckets: _Buckets) -> np.ndarray:
    return np.fromiter(map(buckets.__getitem__, TOKEN.findall((text or "").lower())), np.int64)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, disjoint and in order, in one linear scan.

    Only places of positive score can begin or end one, so that the loop runs over these. Each segment that is kept remembers where its own search to
    the left stopped; later searches go from stop to stop, so that none passes the same segments twice.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to its end, the last one before it whose sum before is less (-1: none)
    for i, lo, hi in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        start, j = i, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= lo:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= hi:
                break
            start, _, lo, _, stop = kept[j]
            del kept[j:]
            j = stop
        kept.append((start, i + 1, lo, hi, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


@dataclass
class ToxicityModel:
    tokens: np.ndarray  # weight by token bucket, NaN where none was seen
    kin: np.ndarray  # weight by beginning's bucket, of tokens that weren't seen
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -30.0

    def weights(self, ids: np.ndarray) -> np.ndarray:
        own = self.tokens[ids >> KIN_BITS]
        return np.where(np.isnan(own), self.kin[ids & (1 << KIN_BITS) - 1], own)

    def evidence(self, ids: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's evidence, and the significant segments as (start, end, lambda S - ln(K n)), in tokens."""
        if not len(ids):
            return 0.0, []
        limit = np.log(max(self.k * len(ids), 1.0))
        found = [(a, b, self.rate * s - limit) for a, b, s in maximal_segments(self.weights(ids) - DRIFT)]
        found = [x for x in found if x[2] > 0]
        return sum(x[2] for x in found), found

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.bias, -30, 30))))


def _solve_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with E exp(lambda s) = 1 over clean tokens."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float(share @ np.exp(np.minimum(x * scores, 700)))
    while f(hi) < 1 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 1 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a weighted logistic curve of one input, by Newton's method with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + ridge * a, (weight * (p - y)).sum() + ridge * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Twice the log-likelihood ratio of counts against the classes' shares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(n / ((toxic + clean) * p)), 0.0) for n, p in ((toxic, share), (clean, 1 - share))]
    return 2 * (parts[0] + parts[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Fits the model on labelled documents outside the held-out fold, at most per_class of either class.

    Tasks count, per bucket, the documents of either class that have it; the counts that reach the driver are at most one row a bucket.
    Without documents of both classes every weight is 0 and every score the share of toxic labels seen (0 if none).
    """
    sample = settle(labelled_sample(docs, labels, "toxic", per_class))  # it is read several times
    size, kin_size = 1 << TOKEN_BITS, 1 << KIN_BITS

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, n = _Buckets(), np.zeros((2, size + kin_size + 1), np.int64)
        for f in frames:
            for t, y in zip(f["text"], f["y"]):
                ids = token_ids(t, buckets)
                n[y, np.unique(ids >> KIN_BITS)] += 1
                n[y, size + np.unique(ids & kin_size - 1)] += 1
                n[y, size + kin_size] += 1
        at = np.flatnonzero(n.sum(0))
        yield pd.DataFrame({"bucket": at, "clean": n[0, at], "toxic": n[1, at]})

    rows = sample.mapInPandas(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    n = np.zeros((2, size + kin_size + 1))
    n[0, rows["bucket"]], n[1, rows["bucket"]] = rows["clean"], rows["toxic"]
    seen, token_n, kin_n = n[:, -1], n[:, :size], n[:, size:-1]
    model = ToxicityModel(np.full(size, np.nan, np.float32), np.zeros(kin_size, np.float32))
    if not seen.all():
        model.bias = 30.0 if seen[1] else -30.0
        return model
    # Counts as if both classes had as many documents.
    level = (seen.sum() / (2 * seen))[:, None]
    share = seen[1] / seen.sum()
    kin_share = (kin_n[1] * level[1] + KIN_PRIOR / 2) / ((kin_n * level).sum(0) + KIN_PRIOR)
    kin_of = np.full(size, -1, np.int64)
    # Only differences that chance doesn't make among so many buckets count: the root of the likelihood ratio against sqrt(2 ln tests).
    limit = 2 * np.log(max((n.sum(0) > 0).sum(), 100))
    kin_sure = _likelihood_ratio(kin_n[1], kin_n[0], share) >= limit
    model.kin = np.where(kin_sure, np.clip(np.log(kin_share / (1 - kin_share)), -8, 8), 0.0).astype(np.float32)

    def kins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, own = _Buckets(), {}
        for f in frames:
            for t in f["text"]:
                ids = np.unique(token_ids(t, buckets))
                own.update(zip((ids >> KIN_BITS).tolist(), (ids & kin_size - 1).tolist()))
        yield pd.DataFrame({"bucket": list(own.keys()), "kin": list(own.values())}, dtype=np.int64)

    known = sample.mapInPandas(kins, "bucket long, kin long").groupBy("bucket").agg(F.min("kin").alias("kin")).toPandas()
    kin_of[known["bucket"]] = known["kin"]
    at = np.flatnonzero(kin_of >= 0)
    prior = np.where(kin_sure[kin_of[at]], kin_share[kin_of[at]], 0.5) * TOKEN_PRIOR
    odds = np.log((token_n[1, at] * level[1] + prior) / (token_n[0, at] * level[0] + TOKEN_PRIOR - prior))
    sure = _likelihood_ratio(token_n[1, at], token_n[0, at], share) >= limit
    model.tokens[at] = np.where(sure | kin_sure[kin_of[at]], np.clip(odds, -8, 8), 0.0)
    clean = token_n[0, at] / max(token_n[0].sum(), 1)
    scores = model.tokens[at].astype(float) - DRIFT
    if not (scores[clean > 0] > 0).any():
        clean = clean + 1e-9 * (scores > 0)
        clean /= clean.sum()
    model.rate = _solve_rate(scores, clean)
    model.k = float(np.clip(clean[scores > 0].sum(), 1e-6, 1.0))  # segments begin at positive tokens: so many a token of clean text

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for f in frames:
            yield pd.DataFrame({"y": f["y"], "e": [model.evidence(token_ids(t, buckets))[0] for t in f["text"]]})

    fitted = sample.mapInPandas(judge, "y int, e double").limit(4 * per_class).toPandas()
    x, y = np.log1p(fitted["e"].to_numpy()), fitted["y"].to_numpy()
    # Each class weighs what it does among all labels to learn from, of which the sample may have less of one.
    whole = {r["y"]: r["n"] for r in labelled(labels, "toxic").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.array([whole.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)])[y]
    model.slope, model.bias = logistic(x, y, weight * len(y) / max(weight.sum(), 1e-9))
    return model


def toxicity_column(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """The score of a text, as score_toxicity() has it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, m = _Buckets(), sent.value
        for f in frames:
            yield pd.Series([m.score(m.evidence(token_ids(t, buckets))[0]) for t in f], dtype=float)

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """({id_col}, score, passages): a row for each row of docs; passages are the significant segments as (start, end, evidence) in tokens.

    A null or empty text has no tokens and the score of no evidence. Repeated rows and null ids stay; other columns aren't returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, m = _Buckets(), sent.value
        for f in frames:
            found = [m.evidence(token_ids(t, buckets)) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "score": [m.score(e) for e, _ in found], "passages": [[{"start": a, "end": b, "evidence": float(s)} for a, b, s in p] for _, p in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "id string, score double, passages array<struct<start:long,end:long,evidence:double>>").select(F.col("id").cast(kind).alias(id_col), "score", "passages")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of score_toxicity() that op2_toxicity returns; held_out is null for a null id."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
