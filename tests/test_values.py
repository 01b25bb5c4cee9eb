"""Coordinates, consensus, gates, epoch, text functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofline.functions.canonical import canonical, violations
from proofline.functions.consensus import consensus
from proofline.functions.eligibility import eligibility, in_date_window
from proofline.functions.epoch import b1950_to_j2000
from proofline.functions.sexagesimal import normalise_dec, normalise_ra, parse_dec, parse_ra
from proofline.functions.text import clean_read, page_class, printed_date, tokens
from proofline.operators.gates import dec_gate, gate_dec_rows, ra_gate


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_normalise(spark):
    assert apply(spark, ["26 45", "2645", "-26 45", "264", "26 4 5", "", None], normalise_dec) == ["-26 45"] * 3 + [None] * 4
    assert apply(spark, ["18 24 08", "182408", "18 24", "1 82408", None], normalise_ra) == ["18 24 08"] * 2 + [None] * 3


def test_parse_takes_the_whole_string(spark):
    got = apply(spark, ["-26 45", "\t-26  45 ", "-26 45\n", "-26 45x", "26 45", None], parse_dec)
    assert [r and (r["deg"], r["min"]) for r in got] == [(26, 45)] * 3 + [None] * 3
    got = apply(spark, ["18 24 08", "18 24", "118 24 08"], parse_ra)
    assert [r and (r["h"], r["m"], r["s"]) for r in got] == [(18, 24, 8), None, None]


REVIEW, OK, NONE = "MANUAL_REVIEW_REQUIRED", "STRUCTURALLY_ADMISSIBLE", "UNREADABLE"


@pytest.mark.parametrize(
    ("value", "state", "part"),
    [
        (None, NONE, "no value"), ("-26 64", REVIEW, "arcminute component 64"), ("-38 84", REVIEW, "arcminute component 84"), ("-76 10", REVIEW, "degree component -76"), ("-19 50", REVIEW, "band"),
        ("-35 00", OK, "possible"), ("-20 00", OK, "possible"), ("-26 59", OK, "possible"), ("x", REVIEW, "does not parse"),
    ],
)
def test_dec_gate(spark, value, state, part):
    r = apply(spark, [value], dec_gate)[0]
    assert r["state"] == state and part in r["reason"]


def test_ra_gate(spark):
    got = apply(spark, ["22 39 84", "68 33 00", "19 50 40", "12 60 00", None], ra_gate)
    assert [r["state"] for r in got] == [REVIEW, REVIEW, OK, REVIEW, NONE]
    assert "second component 84" in got[0]["reason"] and "hour component 68" in got[1]["reason"]


def test_gate_changes_no_input(spark):
    rows = spark.createDataFrame([(1, "-26 64", ["a", None]), (2, None, None)], "k int, value string, raw array<string>")
    assert gate_dec_rows(rows).select(rows.columns).collect() == rows.collect()


def test_consensus(spark):
    reads = [["a", "a", None], ["a", "b", None], [None, None, None], ["b", "a", "a", "b"], None, [], ["", ""]]
    got = [(r["state"], r["value"]) for r in apply(spark, reads, consensus, "array<string>")]
    assert got == [("TRANSCRIBED", "a"), (REVIEW, None), (NONE, None), ("TRANSCRIBED", "b"), (NONE, None), (NONE, None), (NONE, None)]


def test_epoch_goldens(spark):
    def at(h, m, s, d):
        return ((h * 3600 + m * 60 + s) / 240.0, d)

    inputs = [at(14, 45, 10, -(26 + 13 / 60)), at(14, 45, 0, -26.75), at(17, 0, 0, -26.75), at(19, 25, 0, -26.75), at(21, 0, 0, -26.75), at(23, 0, 0, -26.75)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], "i int, ra double, dec double").select("i", b1950_to_j2000(F.col("ra"), F.col("dec")).alias("p")).orderBy("i").collect()
    assert abs(rows[0]["p"]["ra_deg"] * 240 - (14 * 3600 + 48 * 60 + 5.74)) < 0.01
    assert abs(rows[0]["p"]["dec_deg"] + 26.424701) < 1e-5
    wanted = [-(26 + 57 / 60 + 29 / 3600), -(26 + 49 / 60 + 13 / 3600), -(26 + 38 / 60 + 50 / 3600), -(26 + 33 / 60 + 7 / 3600), -(26 + 28 / 60 + 50 / 3600)]
    assert all(abs(r["p"]["dec_deg"] - w) * 3600 < 0.6 for r, w in zip(rows[1:], wanted))


def test_eligibility(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (True, None), (False, True), (None, None)], "a boolean, b boolean")
    got = [r[0] for r in rows.select(eligibility(F.col("a"), F.col("b"))).collect()]
    assert got == ["D2_SPATIAL_ELIGIBLE", "D2_SPATIAL_INELIGIBLE", "DECLINATION_UNKNOWN", "INELIGIBLE_BY_DATE", "INELIGIBLE_BY_DATE"]
    times = spark.sql("select explode(array(timestamp'1977-08-07 23:59:59', timestamp'1977-08-08 00:00:00', timestamp'1977-08-22 23:59:59.999', timestamp'1977-08-23 00:00:00')) t")
    assert [r[0] for r in times.select(in_date_window(F.col("t"))).collect()] == [False, True, True, False]


def test_text(spark):
    assert apply(spark, [" a\nb \n", "", None], clean_read) == ["a b", "", None]
    assert apply(spark, ["  a  b\tc ", ""], tokens) == [["a", "b", "c"], []]
    assert apply(spark, ["x DECLINATION", "CHANNEL NUMBER PAGE", "JOB", "?", None], page_class) == ["HEADER_PAGE", "DATA_PAGE", "JOB_LISTING_PAGE", "UNDETERMINED", None]
    assert [str(d) for d in apply(spark, ["8 AUG 77", "x"], printed_date)] == ["1977-08-08", "None"]


json_values = st.recursive(st.integers() | st.text() | st.booleans() | st.none(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@given(json_values)
@settings(max_examples=80, deadline=None)
def test_canonical_is_idempotent(value):
    import json

    once = canonical(json.dumps(value))
    assert canonical(once) == once and once.isascii() and json.loads(once) == value


def test_violations():
    assert violations('{"a": 1, "b": ["x", {"c": "y"}]}') == []
    assert violations('{"a": true, "status": "x", "b": [null, 1.5]}') == ["forbidden field name status at $", "forbidden scalar type NoneType at $.b[0]", "forbidden scalar type bool at $.a", "forbidden scalar type float at $.b[1]"]


def test_medians_of_any_number(spark):
    """In chunks of few rows and in one: ties, even counts, nulls, a null part, parts without values."""
    import random
    import statistics

    from proofline.operators import profile

    rng = random.Random(3)
    rows = [(g, rng.choice([None, rng.randrange(20), rng.randrange(10**12)])) for g in (None, "a", "b", "c") for _ in range({"a": 4001, "b": 2, "c": 1}.get(g, 300))] + [("d", None), ("e", 5), ("e", 5), ("e", 8), ("e", 9)]
    df = spark.createDataFrame(rows, "folder string, size long")
    of = {}
    for g, v in rows:
        if v is not None:
            of.setdefault(g, []).append(v)
    for chunk in (50, 1 << 20):
        got = {r["folder"]: r["median"] for r in profile.medians(df, "folder", "size", chunk).collect()}
        assert got == {g: float(statistics.median(v)) for g, v in of.items()}
        flagged = profile.size_locator(df, "folder", "size", chunk=chunk)
        assert sorted(map(str, flagged.where("is_candidate").select("folder", "size").collect())) == sorted(f"Row(folder={g!r}, size={v})" for g, own in of.items() for v in own if v < statistics.median(own) * 0.8) and flagged.count() == len(rows)
    assert profile.medians(df.limit(0), "folder", "size").count() == 0


def test_lists_in_numbered_pieces(spark):
    from proofline.operators import profile

    df = spark.createDataFrame([(k, v) for k in ("a", "b", None) for v in range({"a": 2500, "b": 3}.get(k, 10))] * 2 + [("a", None), ("z", None)], "k string, v int")
    for chunk in (300, 1 << 20):
        pieces = profile.value_pieces(df, "k", "v", 1000, chunk).collect()
        assert sorted((str(r["k"]), r["piece"], r["pieces"], len(r["values"])) for r in pieces) == [("None", 0, 1, 10), ("a", 0, 3, 1000), ("a", 1, 3, 1000), ("a", 2, 3, 500), ("b", 0, 1, 3)]
        whole = {r["k"]: r["values"] for r in profile.distinct_values(df, "k", "v").collect()}
        assert {k: [v for r in sorted((r for r in pieces if r["k"] == k), key=lambda r: r["piece"]) for v in r["values"]] for k in whole} == whole


def test_modes_with_ties_and_nulls(spark):
    from proofline.operators import profile

    df = spark.createDataFrame([("p", "b", True), ("p", "a", True), ("p", "c", False), ("q", None, True), ("r", "x", True), ("r", "x", True), ("r", "a", True), (None, "y", True), (None, None, None)], "page string, value string, good boolean")
    got = {r["page"]: (r["value"], r["votes"]) for r in profile.page_value(df, "page", "value", F.col("good")).collect()}
    assert got == {"p": ("a", 1), "q": (None, 0), "r": ("x", 2), None: ("y", 1)}


def test_outcomes_whatever_the_columns_are_called(spark):
    from proofline.operators import profile
    from proofline.operators.rows import voted_rows

    truth = spark.createDataFrame([(1, "a", "t", "u"), (2, "b", "t", "u"), (None, "c", "t", "u")], "k int, value string, _value string, _ok string")
    rows = spark.createDataFrame([(1, "a", "S"), (None, "c", "S")], "k int, value string, state string")
    assert sorted((r["value"], r["_value"], r["_ok"], r["outcome"]) for r in profile.validation_outcomes(truth, rows, ["k"]).collect()) == [("a", "t", "u", "CORRECT_TRANSCRIPTION"), ("b", "t", "u", "UNPAIRED"), ("c", "t", "u", "UNPAIRED")]
    reads = spark.createDataFrame([(["-30 15"] * 3, "v", "g")], "raw_reads array<string>, _v string, _g string")
    assert voted_rows(reads, "dec").select("_v", "_g", "gate_state").collect() == [("v", "g", "STRUCTURALLY_ADMISSIBLE")]


def test_first_attempts_that_tie(spark):
    from proofline.operators import integrity

    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (None, "z")], "position int, page string")
    assert all([r["page"] for r in integrity.first_attempts(df.orderBy(F.rand(s)), "position", 3).collect()] == ["z", "a", "b"] for s in (1, 2, 3))
