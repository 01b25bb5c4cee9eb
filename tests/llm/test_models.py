"""Toxicity and quality: held-out accuracy on the tables, edge cases, and parts against plain versions."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofline.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def slow_segments(scores):
    """Maximal-scoring segments by their definition: the best segment, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] or total == best[2] and j - i < best[1] - 1 - best[0]):
                best = (i, j + 1, total)
    if best is None:
        return []
    a, b, s = best
    return [*slow_segments(scores[:a]), best, *[(x + b, y + b, z) for x, y, z in slow_segments(scores[b:])]]


@given(st.lists(st.integers(-4, 4), max_size=14))
@settings(max_examples=300, deadline=None)
def test_segments_have_the_scores_of_the_definition(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    assert sorted(s for _, _, s in got) == sorted(s for _, _, s in slow_segments(scores))
    assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))
    assert all(sum(scores[a:b]) == s for a, b, s in got)


def test_segments_of_a_million_tokens():
    """Time is linear whatever the shape: rare positive tokens, a rise, a fall, and one segment that takes all."""
    n = 1_000_000
    for scores in (np.tile([1.0, -2.0], n // 2), np.tile([1.0, -0.5], n // 2), np.concatenate([np.tile([1.0, -1.25], n // 4), np.tile([1.25, -1.0], n // 4), [float(n)]]), np.ones(n)):
        began = time.process_time()
        got = toxicity.maximal_segments(scores)
        assert time.process_time() - began < 5 and all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))


def slow_score(model, text):
    """Evidence and score of a text, token by token, from the definitions."""
    weights = []
    for token in re.findall(r"\w+", text.lower()):
        own = model.tokens[zlib.crc32(token.encode()) % (1 << toxicity.TOKEN_BITS)]
        kin = model.kin[zlib.crc32(token[: toxicity.KIN_CHARS].encode()) >> 32 - toxicity.KIN_BITS]
        weights.append(float(kin if math.isnan(own) else own) - toxicity.DRIFT)
    evidence = sum(max(0.0, model.rate * s - math.log(max(model.k * len(weights), 1.0))) for _, _, s in slow_segments(weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * math.log1p(evidence) + model.bias))))


def test_scores_by_their_definition(spark):
    docs, labels = training(spark)
    model = toxicity.fit_toxicity(docs, labels)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["nasty", "vile", "villain", "Nastier", "w1", "w2", "w3", "zzz"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(spark, rows), model).collect()}
    assert all(abs(got[i] - slow_score(model, t)) < 1e-6 for i, t in rows)


def slow_ftrl(rows, size, epochs, seed=7):
    """Follow-the-regularised-leader, coordinate by coordinate."""
    z, n = [0.0] * size, [0.0] * size
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, values, y = rows[k]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, values))))))
            for i, wi, v in zip(at, w, values):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * wi
                n[i] += g * g
    return [weight(i) for i in range(size)]


def test_updates_by_their_definition():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        at = np.unique(rng.integers(0, 64, rng.integers(1, 9)))
        rows.append((at, rng.normal(size=len(at)), int(rng.integers(0, 2))))
    assert np.allclose(quality.fit_ftrl(rows, 6, 3), slow_ftrl(rows, 64, 3), atol=1e-12)


def measured(spark, query, label, threshold):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = query(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    hit = sum(p == 1 and y == 1 for p, y in rows)
    return sum(p == y for p, y in rows) / len(rows), hit / max(1, sum(p for p, _ in rows)), hit / max(1, sum(y for _, y in rows))


def test_held_out_toxicity(spark):
    accuracy, precision, recall = measured(spark, toxicity.op2, "toxic", 0.5)
    assert accuracy > 0.97 and precision > 0.9 and recall > 0.85


def test_held_out_quality(spark):
    accuracy, precision, recall = measured(spark, quality.op10, "quality", 0.3)
    assert accuracy > 0.97 and precision > 0.97 and recall > 0.97


def training(spark, extra=()):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))]
        if bad:
            w[2:2] = ["nasty", "vile"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    labels += [(None, 1, 1), (5000, None, None), (9999, 1, 1), (1, labels[1][1], labels[1][2]), (2, 7, 7)]
    return documents(spark, rows + list(extra)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", [toxicity.op2, quality.op10])
def test_edges(spark, op):
    docs, labels = training(spark, [(d and d + 1000, t) for d, t in awkward()])
    rows = op(docs, labels).collect()
    assert len(rows) == 411 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {None}
    same = [r["score"] for r in rows if r["doc_id"] == 1004]
    assert len(same) == 2 and same[0] == same[1]
    assert len({r["score"] for r in rows if r["doc_id"] in (1001, 1002, 1003)}) == 1


def test_found_passages(spark):
    docs, labels = training(spark)
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(documents(spark, [(1, "w1 w2 w3 nasty vile w4 w5"), (2, "w1 w2 w3")]), model).orderBy("doc_id").collect()
    assert [(p["start"], p["end"]) for p in got[0]["passages"]] == [(3, 5)] and got[0]["score"] > 0.5 > got[1]["score"]


@pytest.mark.parametrize("op", [toxicity.op2, quality.op10])
@pytest.mark.parametrize("keep", ["false", "toxic = 1", "toxic = 0"])
def test_labels_of_one_class_or_none(spark, op, keep):
    docs, labels = training(spark)
    rows = op(docs, labels.where(keep)).collect()
    assert len(rows) == 400 and all(0 <= r["score"] <= 1 for r in rows)
    assert op(docs.limit(0), labels).count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs, labels = training(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for op in (toxicity.op2, quality.op10):
        assert sorted(map(str, op(docs, labels).collect())) == sorted(map(str, op(docs, flipped).collect()))


def test_order_of_rows_is_nothing(spark):
    docs, labels = training(spark)
    for op in (toxicity.op2, quality.op10):
        a = {r["doc_id"]: round(r["score"], 9) for r in op(docs, labels).collect()}
        assert a == {r["doc_id"]: round(r["score"], 9) for r in op(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3)).collect()}
