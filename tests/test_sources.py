"""Sources, sinks, integrity, seals and streams on small files."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from proofline import schemas
from proofline.operators import integrity, profile, seal
from proofline.operators.rows import in_scope, voted_rows
from proofline.sources import fetch, records, sinks, transcribe
from proofline.streaming.resume import done_pages, latest, resume


def test_population(spark):
    runs = spark.createDataFrame([("R-1", "012", 8, 10), ("R-2", "013", 3, 2), ("R-3", "013", 1000, 1000)], schemas.RUNS)
    got = [(r["run"], r["page"], r["source_url"]) for r in records.population(runs, "http://h").orderBy("run", "n").collect()]
    assert got == [("R-1", f"012-{n:03d}", f"http://h/folder.012/012-{n:03d}.jpg") for n in (8, 9, 10)] + [("R-3", "013-1000", "http://h/folder.013/013-1000.jpg")]


def test_manifest_last_wins(spark, tmp_path):
    (tmp_path / "SHA1SUM").write_text("aa  x.jpg\n\nbb y.jpg extra\ncc   y.jpg\n dd x.jpg \nlone\n")
    assert {(r["name"], r["sha1"]) for r in records.checksum_manifest(spark, str(tmp_path / "SHA1SUM")).collect()} == {("x.jpg", "dd"), ("y.jpg", "cc")}


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"page": "p", "row_y": [1, 2]}\n\n{"page": "q", "page_state": "RA_COLUMN_UNRESOLVED"}\n')
    rows = records.json_lines(spark, str(tmp_path / "r.jsonl"), schemas.RA_ROWS).orderBy("line_no").collect()
    assert [(r["page"], r["row_y"], r["page_state"]) for r in rows] == [("p", [1, 2], None), ("q", None, "RA_COLUMN_UNRESOLVED")]
    (tmp_path / "bad.jsonl").write_text('{"page": \n')
    with pytest.raises(Exception):
        records.json_lines(spark, str(tmp_path / "bad.jsonl"), schemas.RA_ROWS).collect()


def test_gate_input(spark):
    text = spark.createDataFrame([('{"p": [{"value": "a"}, {"value": null}]}',), ('[{"value": "b"}]',)], "text string")
    assert sorted((r["page"] or "", r["row"]) for r in records.gate_input(text).collect()) == [("", '{"value":"b"}'), ("p", '{"value":"a"}'), ("p", '{"value":null}')]


def test_gate_input_of_any_shape(spark):
    """One parse a document; what is malformed or of another shape has no rows, and is told apart."""
    texts = ['{"p": [{"value": "a", "n": 1.50}, {"value": null}, 3], "q": [], "r": 1}', '[{"value": "b"}]', "{bad", "3", None, '{"p": [1], "p": [2]}', '{"s": [12345678901234567890123456789, 1e400, [1, {"k": "\u00e9"}]]}', ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = records.gate_input(df)
    assert sorted((r["page"] or "", r["row"]) for r in got.collect()) == sorted([("", '{"value":"b"}'), ("p", '{"n":1.5,"value":"a"}'), ("p", '{"value":null}'), ("p", "3"), ("s", "12345678901234567890123456789"), ("s", '"Infinity"'), ("s", '[1,{"k":"é"}]')])
    assert [r[0] for r in df.select(records.malformed(F.col("text"))).collect()] == [False, False, True, False, False, True, False, True]
    typed = records.gate_rows(df).select(F.try_variant_get("row", "$.value", "string").alias("value")).where("value is not null")
    assert sorted(r["value"] for r in typed.collect()) == ["a", "b"]
    assert str(got._jdf.queryExecution().optimizedPlan()).count("parseJson(") == 1


def png(path, width, height, pixel):
    """A grey PNG file."""
    raw = b"".join(b"\0" + bytes(pixel(x, y) for x in range(width)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_ink_profiles(spark, tmp_path):
    folder = tmp_path / "scans"
    folder.mkdir()
    png(folder / "good.png", 520, 510, lambda x, y: 0 if 100 <= x < 110 else 255)
    png(folder / "small.png", 40, 40, lambda x, y: 255)
    (folder / "broken.png").write_bytes(b"no image")
    rows = records.ink_profiles(spark, str(folder), "x", (90, 130)).collect()
    good = {r["pos"]: r["ink"] for r in rows if r["page"] == "good"}
    assert good == {x: float(100 <= x < 110) for x in range(90, 130)}
    assert {r["page"] for r in rows if r["page_state"] == "SOURCE_INPUT_INVALID"} == {"small", "broken"}


def test_transcription(spark, tmp_path):
    """Two bands of ink in a field between separators, read by an engine that tells how much ink it sees."""
    folder = tmp_path / "pages"
    folder.mkdir()
    ink = lambda x, y: 300 <= y < 312 or 340 <= y < 350 or 100 <= y < 110
    field = lambda x: 1105 <= x < 1170
    png(folder / "p1.png", 1400, 500, lambda x, y: 0 if ink(x, y) and x % 3 == 0 and (field(x) or 1030 <= x < 1050 or 1225 <= x < 1335) else 255)
    png(folder / "blank.png", 1300, 500, lambda x, y: 255)
    png(folder / "tiny.png", 20, 20, lambda x, y: 255)
    engine = lambda band, variant: f" {(band == 0).any(axis=1).sum():02d} {variant[2]}\n"
    rows = {(r["page"], tuple(r["row_y"] or ())): r for r in transcribe.transcribe_ra(spark, str(folder), engine).collect()}
    assert set(rows) == {("p1", (300, 312)), ("p1", (340, 350)), ("blank", ()), ("tiny", ())}
    assert rows["p1", (300, 312)]["raw_reads"] == ["12 30", "12 40", "12 22"] and rows["p1", (300, 312)]["ra_column"] == [1107, 1168]
    assert rows["blank", ()]["page_state"] == "RA_COLUMN_UNRESOLVED" and rows["tiny", ()]["page_state"] == "SOURCE_INPUT_INVALID"
    dec = transcribe.transcribe_dec(spark, str(folder), engine)
    assert {(r["page"], tuple(r["row_y"])) for r in dec.collect()} == {("p1", (100, 110)), ("p1", (300, 312)), ("p1", (340, 350))}
    gated = voted_rows(dec, "dec").where("row_y[0] = 300").first()
    assert gated["normalised"] == ["-12 30", "-12 40", "-12 22"] and gated["extractor_state"] == "MANUAL_REVIEW_REQUIRED" and gated["gate_state"] == "UNREADABLE"


def test_fetching_tries_again(spark):
    pages = spark.createDataFrame([("p1", "good"), ("p2", "bad"), ("p3", "late")], "page string, source_url string")
    tried = []

    def get(url):
        tried.append(url)
        if url == "bad" or url == "late" and tried.count("late") < 3:
            raise OSError("no route")
        return url.encode()

    got = {r["page"]: (r["content"], r["detail"]) for r in fetch.fetched(pages.coalesce(1), get, pause_s=0).collect()}
    assert got == {"p1": (b"good", None), "p2": (None, "OSError: no route"), "p3": (b"late", None)}


def test_scope(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert in_scope(rows, ["a", "b"]).columns == ["a", "b"] and in_scope(rows, ["a", "b"], "b").columns == ["b"]
    with pytest.raises(ValueError, match="c"):
        in_scope(rows, ["a", "b"], "c")


def test_integrity(spark):
    body = b"x" * 60
    pages = spark.createDataFrame([("a", body), ("b", body), ("c", b"short"), ("d", None), ("e", body)], "name string, content binary")
    manifest = spark.createDataFrame([("a", hashlib.sha1(body).hexdigest()), ("b", "00"), ("c", hashlib.sha1(b"short").hexdigest())], schemas.MANIFEST)
    verified = integrity.verified_pages(pages, manifest, least_bytes=50)
    assert {r["name"]: r["failure"] for r in verified.collect()} == {"a": None, "b": "INTEGRITY", "c": "SOURCE_INPUT_INVALID", "d": "DOWNLOAD", "e": "INTEGRITY"}
    assert {r["name"] for r in integrity.failures(verified, "content").collect()} == {"b", "c", "d", "e"}


def test_drift(spark):
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", integrity.PENDING), ("d", "4")], "name string, sha256 string")
    found = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "name string, sha256 string")
    assert {r["name"] for r in integrity.drifted(expected, found).collect()} == {"b", "d"}
    with pytest.raises(ValueError, match="b, d"):
        integrity.require_no_drift(expected, found)
    integrity.require_no_drift(found, found)


def test_seal_is_written_once(spark, tmp_path):
    out = f"file://{tmp_path}/seal"
    dry = seal.seal(spark, {"x": 1}, out)
    assert not (tmp_path / "seal").exists()
    done = seal.seal(spark, {"x": 1}, out, write=True)
    assert done["seal_hash"] == dry["seal_hash"] and json.loads(spark.read.text(out, wholetext=True).first()[0])["status"] == "SEALED"
    with pytest.raises(Exception, match="exist"):
        seal.seal(spark, {"x": 2}, out, write=True)


def test_chain_and_hashes(spark):
    docs = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("{",), (None,)], "text string")
    got = seal.sealed_hashes(docs).collect()
    assert got[0]["canonical_sha256"] == hashlib.sha256(b'{"a":"\\u00e9","b":1}').hexdigest() and got[0]["violations"] == []
    assert got[1]["canonical_sha256"] is None and got[2]["raw_sha256"] is None


def test_pages_are_replaced(spark, tmp_path):
    out = f"file://{tmp_path}/rows"
    make = lambda v: spark.createDataFrame([("012", "p1", v), ("012", "p2", v)], "folder string, page string, v int")
    sinks.replace_pages(make(1), out)
    sinks.replace_pages(make(2).where("page = 'p2'"), out)
    assert sorted((r["page"], r["v"]) for r in spark.read.parquet(out).collect()) == [("p1", 1), ("p2", 2)]


def test_failed_pages_come_again(spark, tmp_path):
    done = f"file://{tmp_path}/done"
    verified = spark.createDataFrame([("p1", True), ("p2", False)], "page string, ok boolean")
    sinks.mark_done(verified, done)
    sinks.append_failures(verified.withColumn("rows", F.lit("x")), f"file://{tmp_path}/failures", "rows")
    left = integrity.todo(spark.createDataFrame([("p1",), ("p2",), ("p3",)], "page string"), spark.read.parquet(done))
    assert {r["page"] for r in left.collect()} == {"p2", "p3"}
    assert spark.read.json(f"file://{tmp_path}/failures").columns == ["ok", "page"]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    spark.createDataFrame([("012", "p1", 1)], "folder string, page string, v int").write.parquet(src)
    taken = []

    def work(batch):
        taken.append(batch.count())
        return batch

    for n in (1, 2):
        if n == 2:
            spark.createDataFrame([("012", "p2", 2)], "folder string, page string, v int").write.mode("append").parquet(src)
        resume(spark, src, "folder string, page string, v int", work, out, check).awaitTermination()
    resume(spark, src, "folder string, page string, v int", work, out, check).awaitTermination()
    assert taken == [1, 1] and latest(spark, out).count() == 2 and {r["page"] for r in done_pages(spark, out).collect()} == {"p1", "p2"}


def test_a_later_batch_replaces_a_page(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = lambda *r: spark.createDataFrame(list(r), "folder string, page string, v int")
    sinks.replace_batch(rows(("012", "p1", 1), ("012", "p2", 1), (None, None, 1)), out, 0)
    sinks.replace_batch(rows(("012", "p2", 2), ("012", "p2", 3), ("013", "p1", 2)), out, 1)
    sinks.replace_batch(rows(("012", "p2", 4), ("013", "p1", 2)), out, 1)  # the same batch again
    got = sorted(map(str, (tuple(r) for r in latest(spark, out).select("folder", "page", "v").collect())))
    assert got == sorted(map(str, [("012", "p1", 1), ("012", "p2", 4), ("013", "p1", 2), (None, None, 1)])) and len(list((tmp_path / "out").glob("batch*"))) == 2


def test_validation_metrics(spark):
    outcomes = ["CORRECT_TRANSCRIPTION"] * 65 + ["STRUCTURALLY_INVALID"] * 2 + ["MANUAL_REVIEW_REQUIRED"] * 22 + ["UNREADABLE"] * 2
    m = profile.validation_metrics(spark.createDataFrame([(o,) for o in outcomes], "outcome string")).first()
    assert (m["n"], m["coverage"], m["accuracy_numeric"], m["accuracy_admissible"]) == (91, 73.6, 97.0, 100.0)
    empty = profile.validation_metrics(spark.createDataFrame([], "outcome string")).first()
    assert empty["n"] == 0 and empty["coverage"] is None


def test_constancy_and_golden(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("b", 1, True), ("b", 2, True), ("c", 1, True), ("c", 2, True), ("c", None, True), ("d", 1, True), ("d", 1, False)], "run string, v int, ok boolean")
    got = {r["run"]: r["class"].replace("CONSTANCY_SAMPLE_", "") for r in profile.constancy_class(rows, "run", "v", F.col("ok")).collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "FAIL_AND_UNREADABLE", "d": "UNREADABLE_OR_AMBIGUOUS"}
    expected = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, None), ("p", 4, "d")], "page string, y0 int, value string")
    produced = spark.createDataFrame([("p", 1, "a", 0), ("p", 2, "b", 0), ("p", 2, "x", 1), ("p", 3, None, 0)], "page string, y0 int, value string, n int")
    compared = profile.golden_compare(expected, produced, ["page", "y0"], ["value"], "n")
    assert {r["y0"]: r["outcome"] for r in compared.collect()} == {1: "MATCH", 2: "DIFFERENT", 3: "MATCH", 4: "NO ROW AT THIS KEY"}
    assert tuple(profile.match_count(compared).first()) == (2, 4, False)


def test_page_value_breaks_ties_by_value(spark):
    rows = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", None), ("q", None)], "page string, v string")
    assert {tuple(r) for r in profile.page_value(rows, "page", "v", F.lit(True)).collect()} == {("p", "a", 1), ("q", None, 0)}
