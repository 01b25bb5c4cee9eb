"""Suffix arrays, repeats and counts against plain versions."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from proofline.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def inside(w, k):
    """How many words lie in runs of k words that stand twice."""
    runs = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    n = Counter(runs)
    return len({j for i, x in enumerate(runs) if n[x] > 1 for j in range(i, i + k)})


def plain(doc_id, text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated, held = inside(w, 3), inside(w, 5)
    failed = len(w) < 50 or 100 * repeated > 50 * len(w)
    kept = not failed and held <= 0.4 * len(w) and not inside(w, 151)
    return (doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, held, failed, kept)


@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_orders_of_suffixes_and_longest_repeats(texts):
    codes, text = np.array([c for t in texts for c in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = np.cumsum([0, *map(len, texts)])
    wanted = sorted(range(len(codes)), key=lambda i: (text[i], codes[i : starts[text[i] + 1]].tolist()))
    assert rules.suffix_order(codes, text).tolist() == wanted

    def longest(t, i):
        return max((next((k for k in range(len(t)) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k]), 0) for j in range(len(t)) if j != i), default=0)

    assert rules.longest_repeats(codes, text).tolist() == [longest(t, i) for t in texts for i in range(len(t))]


def test_spans_are_the_union_of_all_repeats():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(rng.randrange(40))) for _ in range(600)]
    for text, row in zip(texts, rules.rules(texts)):
        w = text.split()
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        places = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        spans = row[-1]
        assert {j for s in spans for j in range(s["start"], s["end"])} == places and all(a["end"] < b["start"] for a, b in zip(spans, spans[1:]))
        assert row[6] == max((k for k in range(1, len(w)) if inside(w, k)), default=0)


def test_documents(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [*awkward(), (20, prose(300)), (21, prose(60) + "\n" + prose(3)), (22, "spam eggs " * 200), (23, (passage := prose(160)) + " " + prose(900) + " " + passage), (24, prose(500) + ("\n" + prose(9)) * 2), (25, "#$ | <a> & *" * 30), (26, "a\x1cb\x85c\xa0d " * 60), (27, "x\n \nx\n\t\nx y\nx")]
    got = sorted((tuple(r) for r in rules.op13(documents(spark, rows)).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)
    of = {r[0]: r for r in got}
    assert of[20][-1] and not of[22][-1] and of[23][-2:] == (False, False)  # a long passage that stands twice is what the method adds
    assert rules.op13(documents(spark, [])).count() == 0


def test_a_table(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").select(["doc_id", "text"]).to_pylist()
    got = sorted(tuple(r) for r in rules.op13(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect())
    assert got == sorted(plain(r["doc_id"], r["text"]) for r in table)


def test_clean_documents_stay(spark):
    """Of the documents that are labelled as good and pass the base rules, the method drops none."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    good = rules.op13(docs).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    assert good.count() > 3000 and good.where("not kept").count() == 0


def test_a_million_words_of_any_shape():
    rng = random.Random(4)
    for text in ("a " * 1_000_000, "a b " * 500_000, " ".join(str(rng.randrange(5000)) for _ in range(1_000_000))):
        began = time.process_time()
        rules.rules([text])
        assert time.process_time() - began < 20
