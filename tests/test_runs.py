"""Whole runs, order of lines, white space, names that clash, ties, and small sinks and sources."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from proofline.functions import canonical, sexagesimal, text
from proofline.functions.epoch import b1950_to_j2000
from proofline.operators import integrity, profile, propagate, sampling, seal
from proofline.operators.reconcile import last_of_each_key
from proofline.sources import records, sinks, transcribe
from proofline.streaming.runner import Run, run_pages

SPACES = [c for c in map(chr, range(0x10000)) if re.match(r"\s", c)]


def test_a_run_from_fetching_to_done(spark, tmp_path):
    """Good pages are written once and marked; each kind of failure is a row, and comes again."""
    body = {f"p{i}": f"page {i} ".encode() * 20 for i in range(6)}
    pages = spark.createDataFrame([("R", "012", p, f"u/{p}") for p in body], "run string, folder string, page string, source_url string")
    sums = [(f"{p}.jpg", hashlib.sha1(b).hexdigest()) for p, b in body.items() if p != "p3"] + [("p3.jpg", "00")]
    manifest = spark.createDataFrame(sums, "name string, sha1 string")
    broken = {"p1", "p4"}

    def fetch(url):
        page = url.split("/")[1]
        if page == "p1" and page in broken:
            raise OSError("no route")
        return b"short" if page == "p2" else body[page]

    def read_page(content):
        n = int(content.split()[1])
        if n == 4 and "p4" in broken:
            raise RuntimeError("engine stopped")
        return [] if n == 5 else [([300 + n, 310], ["30 15", "30 15", "x"]), ([100, 110], ["-31 61"] * 3)]

    run = Run(f"file://{tmp_path}/out", "dec", {"transport": "https", "extractor": "e1", "extractor_sha256": "ab", "gate_sha256": "cd"}, least_bytes=50)
    got = {r["page"]: (r["ok"], r["failure"], r["detail"]) for r in run_pages(pages, manifest, read_page, run, fetch, tries=1, pause_s=0).collect()}
    assert got == {
        "p0": (True, None, None), "p1": (False, "DOWNLOAD", "OSError: no route"), "p2": (False, "SOURCE_INPUT_INVALID", None), "p3": (False, "INTEGRITY", None),
        "p4": (False, "EXTRACTION", "RuntimeError: engine stopped"), "p5": (True, None, None),
    }
    rows = spark.read.parquet(f"{run.out}/rows").orderBy("row_index").collect()
    assert [(r["page"], r["row_y"], r["extractor_value"], r["gate_state"], r["row_index"], r["transport"], r["source_authenticity"]) for r in rows] == [
        ("p0", [100, 110], "-31 61", "MANUAL_REVIEW_REQUIRED", 0, "https", "UNESTABLISHED"),
        ("p0", [300, 310], "-30 15", "STRUCTURALLY_ADMISSIBLE", 1, "https", "UNESTABLISHED"),
    ]
    assert rows[0]["local_sha1"] == hashlib.sha1(body["p0"]).hexdigest() == rows[0]["source_published_sha1"] and rows[0]["byte_integrity"] == integrity.CONSISTENT
    broken.clear()
    again = {r["page"]: r["failure"] for r in run_pages(pages, manifest, read_page, run, fetch, tries=1, pause_s=0).collect()}
    assert again == {"p1": None, "p2": "SOURCE_INPUT_INVALID", "p3": "INTEGRITY", "p4": None}
    assert {r["page"] for r in spark.read.parquet(f"{run.out}/done").collect()} == {"p0", "p1", "p4", "p5"}
    failed = spark.read.json(f"{run.out}/failures")
    assert failed.count() == 6 and "content" not in failed.columns


def test_an_engine_that_raises_fails_its_page(spark, tmp_path):
    from test_sources import png

    folder = tmp_path / "pages"
    folder.mkdir()
    for name in ("p1", "p2"):
        png(folder / f"{name}.png", 1400, 400, lambda x, y: 0 if 300 <= y < 312 and x % 3 == 0 else 255)
    columns = spark.createDataFrame([("p1", 1222, 1340), ("p2", 1222, 1341)], "page string, lo int, hi int")

    def engine(band, variant):
        if band.shape[1] == 119:
            raise ValueError("cannot read")
        return "30 15"

    got = {r["page"]: (r["row_y"], r["raw_reads"], r["failure"], r["detail"]) for r in transcribe.read_bands_of(spark, str(folder), columns, transcribe.bands_of(spark, str(folder), columns), engine).collect()}
    assert got == {"p1": ([300, 312], ["30 15"] * 3, None, None), "p2": (None, None, "EXTRACTION", "ValueError: cannot read")}


@pytest.mark.parametrize("sizes", [(1, 501), (501, 1)])
def test_the_later_file_wins_whatever_its_size(spark, tmp_path, sizes):
    for k, (name, n) in enumerate(zip(("part-0", "part-1"), sizes)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"page": "p", "value": f"{k}-{i}"}) + "\n" for i in range(n)))
    lines = records.json_lines(spark, str(tmp_path), "page string, value string")
    assert last_of_each_key(lines, ["page"], "line_no").first()["value"] == f"1-{sizes[1] - 1}"


def test_the_last_line_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"page": "p", "value": i}) + "\n" for i in range(20_000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = records.json_lines(spark, str(tmp_path / "a.jsonl"), "page string, value long")
        assert lines.rdd.getNumPartitions() > 3 and last_of_each_key(lines, ["page"], "line_no").first()["value"] == 19_999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_all_white_space(spark):
    assert len(SPACES) == 29
    df = spark.createDataFrame([(c, f"{c}-30{c}15{c}", f"{c}01{c}02{c}03{c}", f"{c}a{c}b{c}") for c in SPACES], "c string, dec string, ra string, words string")
    got = df.select("c", sexagesimal.dec_arcminutes(F.col("dec")).alias("dec"), sexagesimal.ra_seconds(F.col("ra")).alias("ra"), text.clean_read(F.col("words")).alias("clean"), text.tokens(F.col("words")).alias("tokens")).collect()
    assert {(r["dec"], r["ra"]) for r in got} == {(-1815, 3723)}
    assert all(r["clean"] == f"a{' ' if r['c'] == chr(10) else r['c']}b" and r["tokens"] == ["a", "b"] for r in got)


def test_a_null_hash_is_drift(spark):
    expected = spark.createDataFrame([("a", None), ("b", integrity.PENDING), ("c", "1")], "name string, sha256 string")
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "name string, sha256 string")
    assert [r["name"] for r in integrity.drifted(expected, found).collect()] == ["a"]


def test_hashes_of_tools(spark, tmp_path):
    (tmp_path / "tool.py").write_bytes(b"x = 1\n")
    assert [tuple(r) for r in integrity.tool_hashes(spark, str(tmp_path / "tool.py")).collect()] == [("tool.py", hashlib.sha256(b"x = 1\n").hexdigest())]


def test_documents_nested_too_deep(spark):
    df = spark.createDataFrame([("[" * 100_000 + "]" * 100_000,), ('{"a": 1.5, "status": 1}',), ("[1",), (None,)], "text string")
    got = [r["f"] for r in df.select(canonical.facts(F.col("text")).alias("f")).collect()]
    assert [f["canonical"] if f else None for f in got] == [None, '{"a":1.5,"status":1}', None, None]
    assert len(got[1]["violations"]) == 2 and got[1]["deterministic"]


def test_epoch_stays_one_small_expression(spark):
    df = spark.range(3).select(F.col("id").cast("double").alias("a"), F.lit(-27.0).alias("d")).select(b1950_to_j2000(F.col("a"), F.col("d")).alias("x"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 6_000


CLASH = ["_mark", "_chunk", "_own", "_part", "_of", "_before", "_i", "_n", "_h", "_f", "_got", "_key0", "_block", "_name", "_last", "_facts"]


def clashing(df):
    """df with columns of all names that operators use inside, by numbers of their own."""
    return df.select("*", *[F.concat(F.lit(f"{c}|"), F.col(df.columns[0]).cast("string")).alias(c) for c in CLASH])


def same_but_for(rows, plain, *columns):
    """That columns of clashing names come back as they were, and the others as without them."""
    assert all(r[c] == f"{c}|{r[columns[0]]}" for r in rows for c in CLASH if c in r)
    assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str([r[c] for c in columns]) for r in plain)


def test_names_that_clash(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, i % 3, i // 3, rng.random() < 0.2, rng.randrange(9)) for i in range(90)], "id int, g int, n int, m boolean, v int")
    for make, columns in (
        (lambda d: propagate.forward_fill(d, "g", "n", F.col("m"), "v", chunk=8), ("id", "filled", "origin", "source")),
        (lambda d: propagate.run_segments(d, "g", "n", F.col("m"), chunk=8), ("id", "run")),
        (lambda d: sampling.first_middle_last(d, "g", "n"), ("id", "position")),
        (lambda d: sampling.at_fractions(d, "g", "n"), ("id",)),
        (lambda d: sampling.every_kth(d, "g", "n"), ("id",)),
        (lambda d: sampling.low_middle_high_and_every_kth(d, "g", "n"), ("id", "chosen_as")),
        (lambda d: sampling.seeded(d, "g", "id", 4, 1), ("id", "rank")),
        (lambda d: profile.size_locator(d, "g", "v"), ("id", "median", "is_candidate")),
        (lambda d: profile.cadence(d, "g", "n", "v"), ("id", "step")),
        (lambda d: profile.golden_compare(d, df.where("v > 2"), ["id"], ["v"], "n"), ("id", "outcome")),
        (lambda d: integrity.verified_pages(d.withColumn("name", F.col("id").cast("string")).withColumn("content", F.lit("x")), spark.createDataFrame([("1", "a")], "name string, sha1 string")), ("id", "failure")),
        (lambda d: propagate.range_join(d, spark.createDataFrame([(1, 2, 9)], "g int, first int, last int"), "g", "n"), ("id", "first")),
        (lambda d: seal.sealed_hashes(d.withColumn("text", F.lit("[1]"))), ("id", "canonical_sha256")),
    ):
        same_but_for(make(clashing(df)).collect(), make(df).collect(), *columns)


def test_ties_are_decided_by_the_other_columns(spark):
    rows = [(1, n // 4, n) for n in range(40)] + [(None, None, 1), (None, 3, 2)]
    df = spark.createDataFrame(rows, "g int, n int, id int")
    for make in (lambda d: sampling.first_middle_last(d, "g", "n"), lambda d: sampling.every_kth(d, "g", "n", 3), lambda d: sampling.at_fractions(d, "g", "n"), lambda d: profile.cadence(d, "g", "n", "id")):
        assert len({str(sorted(map(str, make(df.orderBy(F.rand(s)).repartition(s)).collect()))) for s in (1, 3, 4)}) == 1
    assert {(r["g"], r["position"]): r["id"] for r in sampling.first_middle_last(df, "g", "n").collect()} == {(1, "first"): 0, (1, "middle"): 19, (1, "last"): 39, (None, "first"): 1, (None, "last"): 2}


def test_orders_of_other_kinds(spark):
    df = spark.range(9).select(F.lit("r").alias("g"), F.col("id"), F.expr("date'2020-01-01' + cast(id * 9000 as int)").alias("d"), F.expr("timestamp'2020-01-01' + make_interval(0,0,0,0,0,0,id * 9000)").alias("t"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("s"))
    for order in ("d", "t", "s"):
        assert sorted(r["id"] for r in sampling.every_kth(df, "g", order, 4).collect()) == [0, 4, 8]
        assert {r["step"] for r in profile.cadence(df, "g", order, "id").collect()} == {None, 1}


def test_small_sinks_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("p", [5, 9], ["a"], ["a"], "TRANSCRIBED", "a"), ("p", [1, 4], ["b", None], ["b"], "UNREADABLE", None)], "page string, row_y array<int>, raw_reads array<string>, normalised array<string>, state string, value string")
    made = json.loads(sinks.extractor_json(rows).first()["json"])
    assert [r["row_y"] for r in made["rows"]] == [[1, 4], [5, 9]] and made["rows"][0]["value"] is None
    out = tmp_path / "joined"
    sinks.write_joined(rows.orderBy("row_y"), rows.agg(F.count(F.lit(1)).alias("n")), f"file://{out}")
    assert spark.read.json(f"file://{out}/rows").count() == 2 and spark.read.json(f"file://{out}/summary").first()["n"] == 2
    with pytest.raises(Exception, match="exist"):
        sinks.write_joined(rows, rows, f"file://{out}")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.tar.gz").write_text("é")
    assert [(r["stem"], r["length"]) for r in records.listing(spark, str(tmp_path / "docs")).collect()] == [("x.tar", 2)]
    assert [(r["text"], bytes(r["content"])) for r in records.documents(spark, str(tmp_path / "docs")).collect()] == [("é", "é".encode())]
    with pytest.raises(Exception):
        records.documents(spark, str(tmp_path / "nothing")).collect()
    seen = Observation("progress")
    spark.createDataFrame([(True,), (False,), (None,)], "ok boolean").observe(seen, *sinks.progress_metrics()).collect()
    assert seen.get == {"rows": 3, "failed": 1}
    assert sinks.observed(rows.withColumn("ok", F.lit(True))).count() == 2


def test_stamps_are_in_utc_whatever_the_session(spark):
    df = spark.sql("select timestamp'2024-03-01 12:00:00Z' as t")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert df.select(text.utc_stamp(F.col("t"))).first()[0] == "2024-03-01T12:00:00Z"
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_successes_and_progress(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(12)], "i int, ok boolean")
    assert [integrity.first_successes(df, "i", n).count() for n in (0, 1, 2, 4, 9)] == [0, 1, 4, 10, 12]
    empty = profile.throughput(spark.createDataFrame([], "t timestamp, ok boolean"), "t", "ok", 5).first()
    assert tuple(empty) == (0, 0, None, None, None)


def test_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], "id int, g int, n int, m boolean, v int, name string, content binary")
    ranges = spark.createDataFrame([], "g int, first int, last int")
    for made in (
        propagate.forward_fill(df, "g", "n", F.col("m"), "v"), propagate.run_segments(df, "g", "n", F.col("m")), propagate.range_join(df, ranges, "g", "n"), sampling.first_middle_last(df, "g", "n"), sampling.at_fractions(df, "g", "n"),
        sampling.every_kth(df, "g", "n"), sampling.low_middle_high_and_every_kth(df, "g", "n"), sampling.seeded(df, "g", "id", 2, 1), profile.size_locator(df, "g", "v"), profile.cadence(df, "g", "n", "v"), profile.golden_compare(df, df, ["id"], ["v"], "n"),
        integrity.verified_pages(df, df.select("name", F.lit("a").alias("sha1"))), integrity.done_in_order(df, "id"), integrity.first_successes(df, "n", 3, "m"), seal.unbound(df.select("name", F.lit("{}").alias("text")), df.select("name", F.lit("a").alias("sha256"))),
    ):
        assert made.count() == 0


def test_nulls_in_any_column(spark):
    df = spark.createDataFrame([(1, None, 1, True, 5), (2, None, None, True, 6), (3, 1, 2, None, None), (4, 1, 3, True, None), (5, 1, 4, False, 7), (None, None, 2, False, 8)], "id int, g int, n int, m boolean, v int")
    filled = {r["id"]: (r["filled"], r["origin"], r["source"]) for r in propagate.forward_fill(df, "g", "n", F.col("m"), "v").collect()}
    assert filled == {1: (5, "READ_DIRECTLY", 1), 2: (None, None, None), 3: (None, None, None), 4: (None, "READ_DIRECTLY", 3), 5: (None, "DERIVED", 3), None: (5, "DERIVED", 1)}
    assert {r["id"]: r["run"] for r in propagate.run_segments(df, "g", "n", F.col("m")).collect()} == {1: 1, 2: None, 3: 0, 4: 1, 5: 1, None: 1}
    assert {r["id"]: r["step"] for r in profile.cadence(df, "g", "n", "v").collect()} == {2: None, 1: -1, None: 3, 3: None, 4: None, 5: None}
    assert sampling.every_kth(df, "g", "n", 1).count() == 6 and integrity.done_in_order(df, "g").count() == 1
