"""Decontamination against a search of every window in every document."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from helpers import awkward, documents, words_of
from pyspark.sql import functions as F

from proofline.llm import decontam


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontam.op1(documents(spark, docs), bench).collect()), key=str)


def passages():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(0, 30))) for i in range(25)] + [(None, text(15)), (100, None), (101, ""), (102, "w1"), (103, "W1, w2; w3!"), (7, text(12))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    for i in range(60, 90):  # passages planted in other text
        own = words_of(rng.choice(items)[1])
        docs.append((i, text(rng.randrange(0, 9)) + " -- " + ", ".join(own).upper() + ". " + text(rng.randrange(0, 9))))
    # Repeated rows, one id with two texts, and equal texts without ids.
    return docs + docs[60:63] + [(0, docs[60][1]), (None, docs[61][1]), (None, docs[61][1])] + awkward(), items


def test_against_every_window(spark):
    docs, items = passages()
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("contexts", [1, 3, 64])
def test_joins_by_shuffle_and_crowded_fingerprints(spark, monkeypatch, contexts):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 3)
    monkeypatch.setattr(decontam, "CONTEXTS", contexts)
    docs, items = passages()
    assert run(spark, docs, items) == brute(docs, items)


def test_the_sql_gives_the_same_rows(spark):
    docs, items = passages()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}))
    con.register("benchmark", pa.table({"item_id": pa.array([d for d, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}))
    assert sorted(con.sql(decontam.OP1_SQL).fetchall(), key=str) == run(spark, docs, items)


def test_many_items_of_one_template(spark, monkeypatch):
    """Every item has the same words around a number: their fingerprints are crowded, and no document meets them all."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 1 << 10)
    n = 200_000
    text = F.concat(F.lit("what is the sum of "), F.col("id").cast("string"), F.lit(" and of two and three more now"))
    bench = spark.range(n).select(F.col("id").alias("item_id"), text.alias("text"))
    docs = spark.range(0, n, 100).select(F.col("id").alias("doc_id"), F.concat(F.lit("so: "), text, F.lit(" up")).alias("text"))
    row = decontam.op1(docs, bench).agg(F.count(F.lit(1)), F.min("n_hit"), F.max("n_hit"), F.min("n_items"), F.max("n_items")).first()
    assert tuple(row) == (n // 100, 13, 13, 1, 1)


def test_main_path_is_native(spark):
    docs, items = passages()
    plan = decontam.op1(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_winnowing_keeps_few_places(spark):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(4000))
    places, lengths = decontam.benchmark_places(spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert lengths == [10] and 0.2 * 4000 < places.count() < 0.3 * 4000


def test_a_long_document_of_passages(spark):
    item = " ".join(f"p{i}" for i in range(10))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    row = decontam.op1(documents(spark, [(1, (item + " gap ") * 8000)]), bench).first()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (88_000, 80_000, 1)


def test_empty_tables(spark):
    docs, items = passages()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_spans_are_disjoint_unions(spark):
    bench = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(14)))], "item_id long, text string")
    text = "a b " + " ".join(f"p{i}" for i in range(14)) + " c " + " ".join(f"p{i}" for i in range(2, 13)) + " d"
    row = decontam.decontaminate(documents(spark, [(1, text)]), bench).first()
    assert [tuple(s) for s in row["spans"]] == [(2, 16), (17, 28)] and row["n_hit"] == 25 and row["items"] == ["1"]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 10, 12])
def test_any_gram_length_finds_the_same(spark, k):
    docs, items = passages()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_hit"], r["n_items"]) for r in decontam.decontaminate(documents(spark, docs), bench, k=k).collect()), key=str)
    assert got == sorted(((r[0], r[2], r[3]) for r in brute(docs, items)), key=str)
