"""Exact top-k inner products by KD-trees, one for each shard of the vectors.

A shard is a bounded number of vectors that a task has read. Its tree looks at them along the shard's principal axes, splits at medians of the axis that is widest, down to small
leaves, and keeps a tight box and a ball for every node. A query goes through the nodes best first: no vector in a box scores above
sum(max(q * low, q * high)), and none in a ball above q * centre + |q| * radius; the lesser holds, so that the search ends when the best node left can't reach the kth best score. That score is carried on:
from shard to shard within a task, and into every task as the kth best that the query has among the other queries of its block.

What is saved depends on the vectors. Where they lie near a few directions most leaves are never looked at; where they point anywhere in many dimensions no bound can rule a leaf out, and
the exact search is one of all rows. Queries are sent in blocks of bounded size, each against all rows: a block is so large that its arithmetic, not the reading, takes the time.
Tasks return no more than k rows a query, of which the best k are kept.
Components are integers held as 64-bit floats; where a score might not be exact as such, it is computed in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

SHARD_ROWS, LEAF_ROWS = 16_384, 128
#: Queries of a block, and the bytes of their vectors, at most.
BLOCK_ROWS, BLOCK_BYTES = 32_768, 16 << 20
#: Bounds are computed along rotated axes, with rounding errors below this share of the lengths that go into them.
SLACK = 1e-9
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class KdTree:
    """Over rows of integers held as floats. ids are the rows' names."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        self.widest = float(np.abs(rows).max(initial=0.0))
        self.axes = self._axes(rows)
        order = np.arange(len(ids))
        self._build(rows @ self.axes, order, 0, len(ids), leaf_rows)
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.centre, self.radius = np.array(self.low), np.array(self.high), np.array(self.centre), np.array(self.radius)
        self.longest = float(np.sqrt((rows**2).sum(1).max(initial=0.0))) if self.widest < 1e100 else np.inf

    def _axes(self, rows: np.ndarray) -> np.ndarray:
        """The principal axes as columns; the given ones where there are none or numbers are too large to tell."""
        n = rows.shape[1]
        if n < 2 or len(rows) < 2 or self.widest >= 1e100:
            return np.eye(n)
        centred = (rows - rows.mean(0)) / max(self.widest, 1.0)
        return np.linalg.eigh(centred.T @ centred)[1]

    def _build(self, rows: np.ndarray, order: np.ndarray, start: int, end: int, leaf_rows: int) -> int:
        own = rows[order[start:end]]
        node = len(self.spans)
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.centre.append(own.mean(0))
        with np.errstate(over="ignore", invalid="ignore"):
            self.radius.append(float(np.sqrt(((own - self.centre[node]) ** 2).sum(1).max())))
        self.spans.append((start, end))
        self.children.append(None)
        wide = self.high[node] - self.low[node]
        if end - start > leaf_rows and wide.size and wide.max() > 0:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, int(wide.argmax())], middle)]
            left = self._build(rows, order, start, start + middle, leaf_rows)
            self.children[node] = (left, self._build(rows, order, start + middle, end, leaf_rows))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the most that a vector in the node can score."""
        with np.errstate(over="ignore", invalid="ignore"):
            turned, lengths = queries @ self.axes, np.sqrt((queries**2).sum(1))[:, None]
            box = np.maximum(turned, 0) @ self.high.T + np.minimum(turned, 0) @ self.low.T
            ball = turned @ self.centre.T + lengths * self.radius
            # fmin passes over what isn't a number; where neither is one, nothing is ruled out.
            return np.nan_to_num(np.fmin(box, ball), nan=np.inf, posinf=np.inf) + SLACK * (lengths * self.longest + 1)

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, found: Nearest) -> None:
        """Adds what the tree holds to found. own: the id that takes no part."""
        if float(np.abs(query).max(initial=0.0)) * self.widest * max(1, len(query)) >= EXACT:
            whole = [int(x) for x in query]
            for at in range(len(self.ids)):
                if self.ids[at] != own:
                    found.add(max(LEAST, min(MOST, sum(a * int(b) for a, b in zip(whole, self.rows[at])))), int(self.ids[at]))
            return
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heappop(queue)
            if -bound < found.least:
                return
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= found.least:
                        heappush(queue, (-bounds[child], child))
                continue
            start, end = self.spans[node]
            found.leaves += 1
            scores = self.rows[start:end] @ query
            for at in np.flatnonzero(scores >= found.least).tolist():
                if self.ids[start + at] != own:
                    found.add(int(scores[at]), int(self.ids[start + at]))


class Nearest:
    """The k best (score, id), ties to smaller ids. floor: a kth best score that is known from elsewhere; least: what can still be among them."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.heap, self.least = k, [], floor
        self.leaves = 0  # how many were looked at

    def add(self, score: int, vec_id: int) -> None:
        if score < self.least:
            return
        if len(self.heap) < self.k:
            heappush(self.heap, (score, -vec_id))
        elif (score, -vec_id) > self.heap[0]:
            heapreplace(self.heap, (score, -vec_id))
        if len(self.heap) == self.k:
            self.least = max(self.least, self.heap[0][0])


@dataclass
class Block:
    """Queries of one dimension: their ids, vectors and kth best scores among themselves."""

    ids: np.ndarray
    rows: np.ndarray
    floor: np.ndarray


def _floors(block: Block, start: int, end: int, k: int) -> np.ndarray:
    """A lower bound of the kth best score of queries start to end: the kth best among the block's queries of other ids (each id once). Queries whose scores floats can't hold have none."""
    ids, rows = block.ids, block.rows
    floor = np.full(end - start, -np.inf)
    _, first = np.unique(ids, return_index=True)
    if len(first) <= k or not rows.shape[1] or np.abs(rows).max() ** 2 * rows.shape[1] >= EXACT:
        return floor
    others = rows[first].T
    for lo in range(start, end, 256):
        scores = rows[lo : min(lo + 256, end)] @ others
        scores[ids[lo : min(lo + 256, end), None] == ids[None, first]] = -np.inf
        floor[lo - start : lo - start + len(scores)] = np.partition(scores, -k, axis=1)[:, -k]
    return floor


#: Queries whose floors a task finds at a time.
FLOORS_AT_ONCE = 1024


def with_floors(spark: SparkSession, block: dict[int, Block], k: int) -> dict[int, Block]:
    """The block with its queries' floors, which tasks find: what comes back is a number for each query."""
    if not block:
        return block
    sent = spark.sparkContext.broadcast(block)
    parts = [(n, lo, min(lo + FLOORS_AT_ONCE, len(b.ids))) for n, b in block.items() for lo in range(0, len(b.ids), FLOORS_AT_ONCE)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            floors = [_floors(sent.value[n], lo, hi, k).tolist() for n, lo, hi in zip(f["n"], f["lo"], f["hi"])]
            yield pd.DataFrame({"n": f["n"], "lo": f["lo"], "floors": floors})

    found = spark.createDataFrame(parts, "n int, lo long, hi long").repartition(len(parts)).mapInPandas(run, "n int, lo long, floors array<double>").collect()
    out = {n: Block(b.ids, b.rows, np.full(len(b.ids), -np.inf)) for n, b in block.items()}
    for r in found:
        out[r["n"]].floor[r["lo"] : r["lo"] + len(r["floors"])] = r["floors"]
    sent.destroy()
    return out


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of a batch for each dimension in it, without rows that hold a null or a non-finite component; components become floor(1024 x)."""
    ids = ids.to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sizes = np.diff(offsets)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    for n in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == n))
        yield ids[rows], np.floor(1024 * values[offsets[rows][:, None] + np.arange(n)])


def _block(queries: DataFrame, k: int) -> dict[int, Block]:
    """The queries of one block, by dimension, with their floors. They are collected: the block's size is bounded."""
    table = queries.toArrow().combine_chunks()
    found: dict[int, list] = {}
    for batch in table.to_batches():
        for ids, rows in _by_length(batch.column(0), batch.column(1)):
            found.setdefault(rows.shape[1], []).append((ids, rows))
    out = {}
    for n, parts in found.items():
        ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        out[n] = Block(ids, rows, np.full(len(ids), -np.inf))
    return with_floors(queries.sparkSession, out, k)


def _search_block(vectors: DataFrame, block: dict[int, Block], k: int) -> DataFrame:
    """(query_id, query, vec_id, score): the best of each task for each query of the block."""
    sent = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        nearest = {n: [Nearest(k, f) for f in b.floor.tolist()] for n, b in queries.items()}
        held: dict[int, list] = {n: [] for n in queries}

        def close(n: int) -> None:
            parts, b = held[n], queries[n]
            held[n] = []
            if not parts:
                return
            tree = KdTree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            for lo in range(0, len(b.ids), 512):
                bounds = tree.bounds(b.rows[lo : lo + 512])
                for i, own in enumerate(b.ids[lo : lo + 512].tolist(), lo):
                    tree.search(b.rows[i], own, bounds[i - lo], nearest[n][i])

        for batch in batches:
            for ids, rows in _by_length(batch.column(0), batch.column(1)):
                if (n := rows.shape[1]) in held:
                    held[n].append((ids, rows))
                    if sum(len(p[0]) for p in held[n]) >= SHARD_ROWS:
                        close(n)
        for n in held:
            close(n)
        out = [(int(b.ids[i]), f"{n}/{i}", -v, s) for n, b in queries.items() for i in range(len(b.ids)) for s, v in nearest[n][i].heap]
        columns = [*zip(*out)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["query_id", "query", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, query string, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors for which is_query holds, the k rows of highest inner product, all if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows whose id is null. Rows of a query's own id aren't its candidates; other
    repeated rows all count. Repeats of a query are one query; an id with several vectors is several queries. Vectors are compared with those of
    their own length only. Scores beyond a long's range are its ends. Ties go to the smaller id. Other columns aren't returned.
    """
    each = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where("vec_id is not null")
    queries = each.where("q and v is not null").select("vec_id", "v").distinct()
    n, longest = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return each.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, longest))))
    blocks = -(-n // rows)
    if blocks > 1:
        queries = settle(queries.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))))
    best = []
    for b in range(blocks):
        of = queries if blocks == 1 else queries.where(F.col("b") == b).select("vec_id", "v")
        found = _search_block(each.select("vec_id", "v"), _block(of, k), k)
        order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best.append(ranked if blocks == 1 else settle(ranked))
    return reduce(DataFrame.unionByName, best)


def op5(vectors: DataFrame) -> DataFrame:
    """The ten best of every query, a row whose vec_id is divisible by 100, among all rows."""
    return top_k(vectors, F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
    FROM v AS q, v
    WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs) AS ranked
WHERE rank <= 10
"""
