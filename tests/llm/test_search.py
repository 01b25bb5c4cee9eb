"""Exact top-k search against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, q string, v string, score string"


def wanted(rows, k=10, divisor=100):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out, seen = [], set()
    for i, q in good:
        if i % divisor or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in (kdtree.op5(df) if not kw else kdtree.top_k(df, F.col("vec_id") % 100 == 0, **kw)).collect())


def table(n=900, dims=6, seed=1, levels=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) if levels is None else rng.integers(0, levels, (n, dims)) / 8
    return [(i * 7 - 500, [float(x) for x in row]) for i, row in enumerate(v)]


def test_against_all_pairs(spark):
    assert run(spark, table()) == wanted(table())


def test_ties_go_to_smaller_ids(spark):
    rows = table(levels=2, dims=3)
    assert run(spark, rows) == wanted(rows)


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 50)
    rows = table(1500, 4, 3)
    assert run(spark, rows, k=3, block_rows=4) == wanted(rows, 3)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*table(120, 3), (0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0]), (0, [3.0, 2.0, 1.0]), (100, None), (200, [1.0, None, 2.0]), (300, [nan, 1.0, 1.0]), (400, [1.0, inf, 0.0]), (None, [9.0, 9.0, 9.0]), (500, []), (501, []), (600, [1.0, 1.0]), (601, [2.0, 2.0]), (700, [0.0, 0.0, 0.0]), (702, [-0.0005, 0.0, 0.0])]
    assert run(spark, rows) == wanted(rows)


def test_scores_beyond_floats_and_longs(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [3e7, 1.5]), (3, [1e30, 1.0]), (4, [-1e30, 1.0]), (100, [1e30, 0.0])]
    assert run(spark, rows) == wanted(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(100, [1.0])], [(100, [1.0]), (1, [2.0])]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == wanted(rows)


def test_bounds_hold():
    rng = random.Random(2)
    rows = np.array([[rng.randrange(-99, 99) for _ in range(5)] for _ in range(700)], float)
    tree = kdtree.KdTree(np.arange(700), rows, 20)
    queries = np.array([[rng.randrange(-99, 99) for _ in range(5)] for _ in range(20)], float)
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.spans):
        scores = queries @ tree.rows[a:b].T
        assert (scores.max(1) <= bounds[:, node]).all()
    assert sorted(tree.ids.tolist()) == list(range(700)) and max(b - a for (a, b), c in zip(tree.spans, tree.children) if c is None) <= 20


def leaves_seen(rows, queries):
    """The share of a tree's leaves that searches for ten look at, which find what a search of all rows does."""
    tree, seen = kdtree.KdTree(np.arange(len(rows)), rows), 0
    bounds = tree.bounds(queries)
    for q, b in zip(queries, bounds):
        found = kdtree.Nearest(10)
        tree.search(q, -1, b, found)
        assert sorted(((s, -v) for s, v in found.heap), key=lambda x: (-x[0], x[1])) == sorted(((int(x), i) for i, x in enumerate(rows @ q)), key=lambda x: (-x[0], x[1]))[:10]
        seen += found.leaves
    return seen / len(queries) / sum(c is None for c in tree.children)


def test_leaves_that_are_never_looked_at():
    """Vectors near a few directions of many dimensions let most leaves be passed over; vectors that point anywhere don't."""
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    flat = np.floor(1024 * ((rng.normal(size=(16_384, 64)) * np.array([1.0] * 4 + [0.01] * 60)) @ turn))
    centres = rng.normal(size=(64, 64)) * 3
    heaps = np.floor(1024 * (centres[rng.integers(0, 64, 16_384)] + rng.normal(size=(16_384, 64)) * 0.05))
    anywhere = rng.normal(size=(4096, 64))
    anywhere = np.floor(1024 * anywhere / np.linalg.norm(anywhere, axis=1)[:, None])
    shares = {name: leaves_seen(rows, rows[:60]) for name, rows in (("flat", flat), ("heaps", heaps), ("anywhere", anywhere))}
    print(shares)
    assert shares["flat"] < 0.2 and shares["heaps"] < 0.1
