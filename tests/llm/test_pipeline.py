"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter
from itertools import combinations

import corpus_pipeline as P
from helpers import LOWER, documents, words_of
from test_decontam import brute as leaks

from proofline.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = "".join((text or "").translate(LOWER)).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(texts, least=0.6):
    """(a, b, similarity), a < b, of all pairs at least so alike in five-word shingles."""
    sets = {d: shingles(t) for d, t in texts.items()}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    shared = Counter((a, b) for own in where.values() for a, b in combinations(sorted(own), 2))
    found = ((a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in shared.items())
    return [x for x in found if x[2] >= least]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_each_stage_on_what_the_one_before_it_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_dedup", "decontamination", "sentencepiece"]

    clean = stages["toxicity"](spark, docs, SF).cache()
    scores = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("score < 0.5")
    assert clean.columns == docs.columns and rows_of(clean) == rows_of(docs.join(scores.select("doc_id"), "doc_id", "left_semi").select(docs.columns))
    assert 0 < docs.count() - clean.count() < 0.25 * docs.count()

    good = stages["quality"](spark, clean, SF).cache()
    scores = quality.score_quality(clean, quality.fit_quality(clean, labels)).where("score >= 0.3")
    assert rows_of(good) == rows_of(clean.join(scores.select("doc_id"), "doc_id", "left_semi").select(docs.columns))

    single = stages["near_dedup"](spark, good, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns
    # No two that are left are alike but for a few, and whatever went is alike to another document.
    pairs = similar(texts)
    assert sum(a in kept and b in kept for a, b, s in pairs if s >= 0.8) <= 0.1 * sum(s >= 0.8 for _, _, s in pairs)
    assert texts.keys() - kept <= {d for a, b, s in pairs for d in (a, b) if s >= 0.7}
    # The smallest id of each group stays.
    of = {d: d for d in texts}
    for a, b, s in pairs:
        if s == 1:
            of[max(a, b)] = min(of[max(a, b)], of[min(a, b)])
    assert all(d not in kept for d in texts if of[d] != d)

    free = stages["decontamination"](spark, single, SF).cache()
    hit = {r[0] for r in leaks([(d, texts[d]) for d in kept], [(r["item_id"], r["text"]) for r in bench.collect()]) if r[5]}
    assert hit and sorted(r["doc_id"] for r in free.collect()) == sorted(kept - hit)

    coded = stages["sentencepiece"](spark, free, SF)
    assert coded.count() == free.count() and coded.where("not exact").count() == 0


def test_whole_run(spark):
    assert P.ORACLE_SQL is None and P.run(spark, SF).count() > 0


def test_awkward_groups(spark):
    rows = [(5, "one two three four"), (3, "One  two\nthree FOUR"), (3, "One  two\nthree FOUR"), (3, "one two three four"), (None, "one two three four"), (7, None), (8, ""), (None, "quite another text here"), (None, "quite another text here")]
    kept = P.keep_one_of_each_group(spark, documents(spark, rows), SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "7", "None"]
    assert {tuple(r)[2:] for r in kept} == {tuple(r)[2:] for r in documents(spark, rows[:1]).collect()}  # columns of any name are given back as they were
    assert P.keep_one_of_each_group(spark, documents(spark, []), SF).count() == 0


def test_awkward_documents_pass_decontamination(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, None), (None, None), (2, ""), (3, f"before {item} after"), (3, "same id, clean"), (None, item), (4, "clean"), (4, "clean")]
    kept = P.remove_benchmark_passages(spark, documents(spark, rows), SF).collect()
    assert len(words_of(item)) > 0 and sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted([("1", "None"), ("None", "None"), ("2", ""), ("3", "same id, clean"), ("4", "clean"), ("4", "clean")])
