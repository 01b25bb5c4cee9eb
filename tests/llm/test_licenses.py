"""License scans against a plain search."""

import random

import duckdb
import pyarrow as pa
from helpers import awkward, documents, words_of

from proofline.llm import licenses

BASE = dict(licenses.NAMES)


def base_places(text):
    w = words_of(text)
    return sorted((i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def texts():
    rng = random.Random(9)
    filler = ["the", "license", "public", "by", "cc", "mit", "gnu", "code", "general", "apache", "work", "free"]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(rng.randrange(0, 80)))) for i in range(100, 260)]
    rows += [
        (1, "Released under the MIT License."), (2, "GNU General Public License, version 3. GNU GENERAL PUBLIC LICENSE"), (3, "CC-BY 4.0 and cc by cc by"), (4, "Apache\nLicense; apache license"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (6, "Licensed under the Apache License, Version 2.0"),
        (7, "Permission is hereby granted free of charge"), (8, "permission was hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (9, "mit licenses and apache licensed"), (10, "gnu general public"),
    ]
    return rows + [(d and d + 1000, t) for d, t in awkward()]


def test_base_places(spark):
    rows = texts()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.op9(documents(spark, rows)).collect())
    wanted = []
    for d, t in rows:
        p = base_places(t)
        wanted.append((str(d), len(words_of(t)), len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({label for _, label in p}))))
    assert got == sorted(wanted, key=lambda r: tuple(map(str, r))) or sorted(map(str, got)) == sorted(map(str, wanted))


def test_labels_of_notices(spark):
    got = {r["doc_id"]: r for r in licenses.op9(documents(spark, texts())).collect()}
    assert got[2]["labels"] == "gpl,gpl-3.0" and got[6]["labels"] == "apache,apache-2.0"
    assert got[5]["labels"] == "mit" and got[5]["base_labels"] == "" and got[5]["score"] == 1.0
    # Words alone don't do: one of the key phrases must stand word for word.
    assert got[7]["labels"] == "" and 0 < got[7]["score"] < 1
    assert got[8]["labels"] == "" and got[8]["score"] == 0
    assert got[9]["labels"] == "" and got[10]["labels"] == ""
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got.values())


def test_every_template_finds_itself(spark):
    templates = [(text, label) for text, label, _ in licenses.BODIES] + licenses.PHRASES + licenses.NAMES
    got = {r["doc_id"]: r for r in licenses.op9(documents(spark, list(enumerate(text for text, _ in templates)))).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1.0 for i, (_, label) in enumerate(templates))


def altered(rng):
    """Licences as files have them: words replaced, left out and put in (a twentieth of each text), or a half cut off, between other words. (label, text) each."""
    filler = ["import", "def", "return", "data", "value", "this", "the", "of", "copyright", "2024", "by", "name"]
    out = []
    for text, label, _ in licenses.BODIES:
        own = words_of(text)
        if len(own) < 40:
            continue
        for k in range(12):
            w = list(own)
            if k % 2:
                for _ in range(max(1, len(w) // 20)):
                    at = rng.randrange(len(w))
                    w[at : at + rng.randrange(2)] = rng.choice([[], ["changed"], ["two", "words"]])
            else:
                at = rng.randrange(len(w) * 2 // 5)
                w = w[at : at + len(w) * 3 // 5]
            around = [rng.choice(filler) for _ in range(200)]
            out.append((label, " ".join(around[:100] + w + around[100:])))
    return out


def test_edited_and_cut_licences(spark):
    made = altered(random.Random(12))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.op9(documents(spark, [(i, t) for i, (_, t) in enumerate(made)])).collect()}
    found = sum(label in got[i] for i, (label, _) in enumerate(made))
    print(f"found {found} of {len(made)}", [(i % 2, label) for i, (label, _) in enumerate(made) if label not in got[i]])
    assert found >= 0.9 * len(made)


def test_the_sql_gives_the_same_rows(spark):
    rows = texts() + [(2000 + i, t) for i, (_, t) in enumerate(altered(random.Random(3)))] + [(1, "Released under the MIT License."), (None, "mit license")]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    assert sorted(con.sql(licenses.OP9_SQL).fetchall(), key=str) == sorted((tuple(r) for r in licenses.op9(documents(spark, rows)).collect()), key=str)


def test_a_long_file_of_names(spark):
    row = licenses.op9(documents(spark, [(1, "cc by mit license " * 40_000)])).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (80_000, 0, 159_998, "cc-by,mit")


def test_no_documents(spark):
    assert licenses.op9(documents(spark, [])).count() == 0


def test_one_plan_without_python(spark):
    plan = licenses.op9(documents(spark, [(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan
