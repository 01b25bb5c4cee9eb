"""Pages from images and bytes to reconciled rows: one pass, page-level records, tool checks, and what a run leaves behind."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import png

from proofline.operators import integrity, segments
from proofline.operators.reconcile import Sides, reconcile, summary
from proofline.sources import kernel, records, sinks, tables, transcribe
from proofline.streaming import runner
from proofline.streaming.runner import PageRead, Run, by_images, rows_of, run_pages


def an_engine():
    """Tells how much ink it sees; made in a function, so that workers get it whole."""
    return lambda band, variant: f" {(band == 0).any(axis=1).sum():02d} {variant[2]}\n"


engine = an_engine()


def test_runs_in_arrays_are_runs_in_tables(spark):
    rng = random.Random(4)
    pages = {p: sorted(rng.sample(range(60), rng.randrange(1, 60))) for p in range(40)}
    ink = {(p, x): rng.choice([0.0, 0.0, 0.04, 0.5, 1.0]) for p, own in pages.items() for x in own}
    profile = spark.createDataFrame([(p, x, v) for (p, x), v in ink.items()], "page int, x int, ink double")
    held = segments._runs(profile, "page", "x", F.col("ink") > 0.1)
    got = {(r["page"], r["start"], r["end"], r["at_end"]) for r in held.collect()}
    assert got == {(p, *run) for p, own in pages.items() for run in kernel.runs_of(np.array([ink[p, x] > 0.1 for x in own]), np.array(own))}
    whole = {p: np.array([rng.choice([0.0, 0.0, 0.5, 1.0]) for _ in range(60)]) for p in range(60)} | {60: np.zeros(60)}
    profile = spark.createDataFrame([(p, 100 + x, float(v)) for p, own in whole.items() for x, v in enumerate(own)], "page int, x int, ink double")
    limits = {"left_limit": 125, "right_limit": 135, "narrowest": 5}
    got = {r["page"]: r["lo"] and (r["lo"], r["hi"]) for r in segments.locate_column(profile, **limits).collect()}
    assert got == {p: kernel.field(own, 100, **limits, shortest=segments.SEPARATOR_MIN) for p, own in whole.items()}
    got = {(r["page"], r["start"], r["end"]) for r in segments.row_bands(profile.select("page", (F.col("x") - 100).alias("y"), "ink"), shortest=1, longest=4, from_y=5).collect()}
    assert got == {(p, *b) for p, own in whole.items() for b in kernel.bands(own, shortest=1, longest=4, from_y=5)}


def test_one_pass_gives_what_the_steps_give(spark, tmp_path):
    rng = random.Random(6)
    folder = tmp_path / "pages"
    folder.mkdir()
    for k in range(3):
        bands, left, right = [(y, y + rng.randrange(4, 30)) for y in range(90, 480, 60)], 1100 + rng.randrange(5), 1165 + rng.randrange(9)
        inked = {y for a, b in bands for y in range(a, b)}
        png(folder / f"p{k}.png", 1400, 500, lambda x, y: 0 if y in inked and x % 3 == 0 and (left <= x < right or 1030 <= x < 1050 or 1225 <= x < 1335) else 255)  # noqa: B023
    png(folder / "blank.png", 1300, 500, lambda x, y: 255)
    (folder / "broken.png").write_bytes(b"no image")
    columns = transcribe.columns_of(spark, str(folder))
    steps = transcribe.read_bands_of(spark, str(folder), columns, transcribe.bands_of(spark, str(folder), columns, from_y=segments.HEADER_Y), engine).select("page", "row_y", "raw_reads")
    made = transcribe.transcribe_ra(spark, str(folder), engine)
    assert sorted(map(str, made.where("row_y is not null").select("page", "row_y", "raw_reads").collect())) == sorted(map(str, steps.collect())) and steps.count() > 6
    assert {(r["page"], r["page_state"]) for r in made.where("row_y is null").collect()} == {("blank", kernel.UNRESOLVED), ("broken", kernel.INVALID)}
    assert {(r["page"], tuple(r["ra_column"])) for r in made.where("row_y is not null").collect()} == {(r["page"], (r["lo"], r["hi"])) for r in columns.where("lo is not null").collect()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") == 1 and "Exchange" not in plan


def test_a_page_whose_engine_raises_fails_alone(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for name, y0 in (("p1", 300), ("p2", 310)):
        png(folder / f"{name}.png", 1400, 500, lambda x, y: 0 if y0 <= y < 312 and x % 3 == 0 else 255)  # noqa: B023

    def broken(band, variant):
        if band.shape[0] < 18:
            raise ValueError("cannot read")
        return "x"

    got = {(r["page"], tuple(r["row_y"] or ())): (r["failure"], r["detail"]) for r in kernel.page_rows(kernel.transcribed(records.images(spark, str(folder)), broken, kernel.Layout(columns=(1222, 1340), from_y=None))).collect()}
    assert got == {("p1", (300, 312)): (None, None)} or got == {("p1", (300, 312)): (None, None), ("p2", ()): ("EXTRACTION", "ValueError: cannot read")}


PROVENANCE = {"transport": "https", "extractor": "e", "extractor_sha256": "ab", "gate_sha256": "cd"}


def pages_of(spark, body):
    pages = spark.createDataFrame([("R", "013", p, f"u/{p}") for p in body], "run string, folder string, page string, source_url string")
    return pages, spark.createDataFrame([(f"{p}.jpg", hashlib.sha1(b).hexdigest()) for p, b in body.items()], "name string, sha1 string")


def test_page_level_records_reach_the_reconciler(spark, tmp_path):
    """p3's field isn't found on one side: its rows on the other are unpaired, as the page is there. p4 has no rows on that side and no record: the page is missing."""
    body = {p: f"page {p} ".encode() * 20 for p in ("p1", "p3", "p4")}
    pages, manifest = pages_of(spark, body)
    row = lambda y, text: ([y, y + 10], [text] * 3)
    reads = {
        "dec": {"p1": PageRead([row(y, "-30 15") for y in (100, 140, 180)]), "p3": [row(100, "-30 15"), row(140, "-30 15")], "p4": [row(100, "-31 20")]},
        "ra": {"p1": PageRead([row(y, "01 02 03") for y in (100, 140, 180)], columns=(1107, 1168)), "p3": PageRead(state="RA_COLUMN_UNRESOLVED"), "p4": PageRead(columns=(1107, 1168))},
    }
    sides = {}
    for kind in ("dec", "ra"):
        run = Run(f"file://{tmp_path}/{kind}", kind, PROVENANCE, least_bytes=50)
        own = reads[kind]
        got = run_pages(pages, manifest, lambda content: own[content.split()[1].decode()], run, lambda url: body[url.split("/")[1]], tries=1, pause_s=0)  # noqa: B023
        assert {(r["page"], r["ok"]) for r in got.collect()} == {("p1", True), ("p3", True), ("p4", True)}
        sides[kind] = rows_of(spark, run.out)
        assert not os.path.exists(f"{tmp_path}/{kind}/work") or not os.listdir(f"{tmp_path}/{kind}/work")
    level = sides["ra"].where("row_y is null").collect()
    assert [(r["page"], r["page_state"], r["row_index"], r["ra_column"], r["gate_state"], r["transport"], r["byte_integrity"]) for r in level] == [("p3", "RA_COLUMN_UNRESOLVED", None, None, None, "https", integrity.CONSISTENT)]
    assert {tuple(r["ra_column"]) for r in sides["ra"].where("row_y is not null").collect()} == {(1107, 1168)}
    verdicts = {(r["page"], r["pairing_verdict"]): r["count"] for r in reconcile(sides["dec"], sides["ra"], Sides()).groupBy("page", "pairing_verdict").count().collect()}
    assert verdicts == {("p1", "PAIRED"): 3, ("p3", "UNPAIRED_DEC_ONLY"): 2, ("p4", "PAGE_MISSING_ON_OTHER_SIDE"): 1}
    counts = summary(sides["dec"], sides["ra"]).first()
    assert counts["ra_page_level_records_skipped"] == 1 and counts["n_pages_only_dec"] == 1


def test_a_run_whose_tools_have_changed_writes_nothing(spark, tmp_path):
    pages, manifest = pages_of(spark, {"p1": b"x" * 60})
    tool = lambda h: spark.createDataFrame([("e.py", h)], "name string, sha256 string")
    run = Run(f"file://{tmp_path}/out", "dec", PROVENANCE, least_bytes=50, tools=(tool("1"), tool("2")))
    with pytest.raises(ValueError, match="e.py"):
        run_pages(pages, manifest, lambda content: [], run, lambda url: b"x" * 60)
    assert not (tmp_path / "out").exists()
    same = Run(run.out, "dec", PROVENANCE, least_bytes=50, tools=(tool("1"), tool("1")))
    assert run_pages(pages, manifest, lambda content: [], same, lambda url: b"x" * 60).count() == 1


def test_a_run_that_is_cut_off_leaves_nothing_that_counts(spark, tmp_path, monkeypatch):
    body = {p: f"page {p} ".encode() * 20 for p in ("p1", "p2")}
    pages, manifest = pages_of(spark, body)
    run = Run(f"file://{tmp_path}/out", "dec", PROVENANCE, least_bytes=50)
    read = lambda content: [([100, 110], ["-30 15"] * 3)]
    fetch = lambda url: body[url.split("/")[1]]

    def stopped(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "mark_done", stopped)
        with pytest.raises(RuntimeError, match="lost"):
            run_pages(pages, manifest, read, run, fetch)
    assert rows_of(spark, run.out).count() == 0 and spark.read.parquet(f"{run.out}/rows").count() == 2
    assert run_pages(pages, manifest, read, run, fetch).count() == 2 and rows_of(spark, run.out).count() == 2
    assert run_pages(pages, manifest, read, run, fetch).count() == 0 and rows_of(spark, run.out).count() == 2


def test_from_fetched_images_to_rows(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    ink = lambda x, y: 300 <= y < 312 or 340 <= y < 350
    png(source / "p1.png", 1400, 500, lambda x, y: 0 if ink(x, y) and x % 3 == 0 and (1105 <= x < 1170 or 1030 <= x < 1050 or 1225 <= x < 1335) else 255)
    png(source / "p 2é.png", 1300, 500, lambda x, y: 255)
    body = {"p1": (source / "p1.png").read_bytes(), "p 2é": (source / "p 2é.png").read_bytes(), "p3": b"no image" * 20}
    pages, manifest = pages_of(spark, body)
    run = Run(f"file://{tmp_path}/out", "ra", PROVENANCE, least_bytes=50)
    got = run_pages(pages, manifest, by_images(engine), run, lambda url: body[url.split("/")[1]], nested=True)
    assert got.where("ok").count() == 3
    rows = {(r["page"], tuple(r["row_y"] or ())): r for r in rows_of(spark, run.out).collect()}
    assert set(rows) == {("p1", (300, 312)), ("p1", (340, 350)), ("p 2é", ()), ("p3", ())}
    assert rows["p1", (300, 312)]["raw_reads"] == ["12 30", "12 40", "12 22"] and rows["p1", (340, 350)]["row_index"] == 1
    assert rows["p 2é", ()]["page_state"] == kernel.UNRESOLVED and rows["p3", ()]["page_state"] == kernel.INVALID
    assert not os.path.exists(tmp_path / "out" / "work") or not os.listdir(tmp_path / "out" / "work")


def test_runs_in_slices_tell_how_far_they_are(spark, tmp_path):
    body = {f"p{i}": f"page {i} ".encode() * 20 for i in range(24)}
    pages, manifest = pages_of(spark, body)
    run = Run(f"file://{tmp_path}/out", "dec", PROVENANCE, least_bytes=50)
    seen = []

    def read(content):
        return [([100, 110], ["-30 15"] * 3)]

    def fetch(url):
        if url == "u/p5":
            raise OSError("no route")
        return body[url.split("/")[1]]

    for outcome in runner.run_in_slices(pages, manifest, read, run, 3, fetch=fetch, tries=1, pause_s=0):
        told = spark.read.json(f"{run.out}/progress").orderBy("at").collect()
        seen.append((outcome.count(), len(told), told[-1]["done"], told[-1]["failed"], told[-1]["total"]))
    assert [s[1] for s in seen] == [1, 2, 3] and sum(s[0] for s in seen) == 24 and seen[-1][2:] == (23, 1, 24)
    last = told[-1]
    assert last["per_hour"] > 0 and last["remaining_s"] >= 0 and told[0]["remaining_s"] > 0


def test_nothing_yet_and_what_cannot_be_read(spark, tmp_path):
    assert tables.parquet_if_any(spark, f"file://{tmp_path}/none", "page string").count() == 0
    with pytest.raises(Exception, match="(?i)scheme|FileSystem"):
        tables.parquet_if_any(spark, "nowhere://x/y", "page string").count()
