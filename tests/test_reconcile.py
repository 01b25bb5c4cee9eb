"""Fixtures of the reconciler: each with the verdict counts that it must give, and no others."""

from itertools import chain

import pytest

from proofline.operators import reconcile as R

SIDES = R.Sides(left_fields=("row_index", "value"), right_fields=("row_index", "value"), shared=("run",))
SCHEMA = "page string, row_y array<int>, row_index int, value string, run string, line_no long"


def rows(*bands, page="p1", start=0):
    return [(page, [y, y + 15], i, f"v{y}", "R", start + i) for i, y in enumerate(bands)]


def side(spark, *parts):
    return spark.createDataFrame([(*r[:5], n) for n, r in enumerate(chain(*parts))], SCHEMA)


def counts(spark, left, right):
    records = R.reconcile(side(spark, *left), side(spark, *right), SIDES)
    return {r["pairing_verdict"]: r["n"] for r in R.verdict_counts(records).collect()}, records


D = rows(100, 120, 140)
CASES = [
    ([D], [D], {"PAIRED": 3}),
    ([D], [rows(100, 140)], {"PAIRED": 2, "UNPAIRED_DEC_ONLY": 1}),
    ([D], [rows(100, 120, 140, 160)], {"PAIRED": 3, "UNPAIRED_RA_ONLY": 1}),
    ([D], [rows(102, 122, 142)], {"UNPAIRED_DEC_ONLY": 3, "UNPAIRED_RA_ONLY": 3}),
    ([D], [rows(100, 121, 140)], {"PAIRED": 2, "UNPAIRED_DEC_ONLY": 1, "UNPAIRED_RA_ONLY": 1}),
    ([D], [D, [("p1", [120, 135], 9, "DUP", "R", 0)]], {"PAIRED": 2, "PAIRING_UNRESOLVED": 1}),
    ([D], [rows(140, 100, 120)], {"PAIRED": 3}),
    ([D, rows(100, page="p2")], [D], {"PAIRED": 3, "PAGE_MISSING_ON_OTHER_SIDE": 1}),
    ([D], [D, [("p3", None, None, None, "R", 0)]], {"PAIRED": 3}),
    ([rows(100, 120, 140, 160, 180)], [D], {"PAIRED": 3, "UNPAIRED_DEC_ONLY": 2}),
    # A page of which the other side has a page-level record only is there.
    ([D, rows(100, page="p3")], [D, [("p3", None, None, None, "R", 0)]], {"PAIRED": 3, "UNPAIRED_DEC_ONLY": 1}),
    ([D, [("p1", [100, 115], 7, "DUP", "R", 0)]], [D], {"PAIRED": 2, "PAIRING_UNRESOLVED": 1}),
    ([D, rows(100, 100, page="p4")], [D], {"PAIRED": 3, "PAIRING_UNRESOLVED": 1}),
    ([rows(100, page=None)], [rows(100, page=None)], {"PAIRED": 1}),
    ([rows(100, page=None)], [D], {"PAGE_MISSING_ON_OTHER_SIDE": 4}),
    ([], [D], {"PAGE_MISSING_ON_OTHER_SIDE": 3}),
    ([], [], {}),
]


@pytest.mark.parametrize(("left", "right", "wanted"), CASES)
def test_verdicts(spark, left, right, wanted):
    assert counts(spark, left, right)[0] == wanted


def test_last_copy_and_index(spark):
    _, records = counts(spark, [D, [("p1", [100, 115], 7, "LAST", "R", 0)]], [rows(140, 100, 120)])
    got = {r["row_y"][0]: r for r in records.collect()}
    assert got[100]["dec"]["value"] == "LAST" and (got[100]["dec_copies"], got[100]["ra_copies"]) == (2, 1)
    assert got[120]["row_index_agreement"] == "DIFFER" and "(1 vs 2)" in got[120]["pairing_reason"]
    assert got[100]["row_index_agreement"] is None


def test_sides_are_null_where_absent(spark):
    _, records = counts(spark, [rows(100)], [rows(100, 120)])
    got = {r["row_y"][0]: r for r in records.collect()}
    assert got[120]["dec"] is None and got[120]["ra"]["value"] == "v120" and got[100]["pairing_reason"] is None


def test_summary_and_order(spark):
    left, right = side(spark, D, rows(100, page="p2")), side(spark, rows(140, 100, 120), [("p3", None, None, None, "R", 0), (None, None, None, None, "R", 0)])
    records = R.reconcile(left, right, SIDES)
    s = R.summary(left, right, SIDES).first().asDict()
    assert (s["dec_rows_indexed"], s["ra_rows_indexed"], s["ra_page_level_records_skipped"], s["dec_page_level_records_skipped"]) == (4, 3, 2, 0)
    assert (s["pages_dec"], s["pages_ra"], s["pages_either_side"], s["n_pages_only_dec"], s["n_pages_only_ra"]) == (2, 3, 4, 1, 1)
    assert (s["n_paired"], s["n_page_missing_on_other_side"], s["row_index_disagreements_among_paired"]) == (3, 1, 3)
    assert {(r["page"], r["side"]) for r in R.pages_of_one_side(left, right, SIDES).collect()} == {("p2", "dec"), ("p3", "ra")}
    ordered = [(r["page"], r["row_y"][0]) for r in R.in_output_order(records, SIDES).collect()]
    assert ordered == [("p1", 100), ("p1", 120), ("p1", 140), ("p2", 100)]


def test_row_order_of_input_is_nothing(spark):
    a = counts(spark, [D, rows(100, page="p2")], [rows(100, 140)])[1]
    left = side(spark, D, rows(100, page="p2"))
    b = R.reconcile(left.orderBy("line_no", ascending=False), side(spark, rows(100, 140)).repartition(3), SIDES)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_rows_are_shuffled_once(spark, sf_dir):
    """Both sides are gathered by the key in one exchange; the pages that one side lacks are broadcast."""
    from proofline.plans import reconciliation

    plan = reconciliation.QUERIES["reconcile_rows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_many_pages_of_one_side(spark, monkeypatch):
    left, right = [D, rows(100, page="p2"), rows(100, page=None)], [D]
    wanted = counts(spark, left, right)[0]
    monkeypatch.setattr(R, "BROADCAST_PAGES", 0)
    assert counts(spark, left, right)[0] == wanted == {"PAIRED": 3, "PAGE_MISSING_ON_OTHER_SIDE": 2}


def test_last_of_ties_is_the_same_on_every_run(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (1, 4, "z")], "k int, n int, v string")
    assert {R.last_of_each_key(df.repartition(n), ["k"], "n").first()["v"] for n in (1, 3, 4)} == {"c"}
