"""Queries that reconcile two sides and compare sets. Both sides are taken from lineitem, whose (order, line) keys repeat, so that every verdict occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, profile, reconcile, sets
from .registry import Registry, table

query = Registry()

SIDES = reconcile.Sides(left="dec", right="ra", left_fields=("idx", "value"), right_fields=("idx", "value"), shared=("supplier",), index="idx")

_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
SIDES_SQL = f"""
    l AS (SELECT l_orderkey AS page, CASE WHEN l_orderkey % 13 = 0 AND l_returnflag = 'R' THEN NULL ELSE l_linenumber END AS row_y, (l_partkey % 4)::INTEGER AS idx, l_extendedprice AS value, l_suppkey AS supplier, ROW({", ".join(_ORDER)}) AS ord FROM lineitem WHERE l_orderkey % 17 <> 0),
    r AS (SELECT l_orderkey AS page, CASE WHEN l_orderkey % 11 = 0 AND l_returnflag = 'A' THEN NULL ELSE l_linenumber END AS row_y, CASE WHEN l_quantity < 25 THEN (l_partkey % 4)::INTEGER END AS idx, l_extendedprice AS value, l_suppkey AS supplier, ROW({", ".join(_ORDER)}) AS ord FROM lineitem WHERE l_quantity <= 35 AND l_orderkey % 7 <> 0),
    lk AS (SELECT page, row_y, count(*) AS copies, arg_max({{'idx': idx, 'value': value, 'supplier': supplier}}, ord) AS x FROM l WHERE row_y IS NOT NULL GROUP BY page, row_y),
    rk AS (SELECT page, row_y, count(*) AS copies, arg_max({{'idx': idx, 'value': value, 'supplier': supplier}}, ord) AS x FROM r WHERE row_y IS NOT NULL GROUP BY page, row_y),
    lp AS (SELECT DISTINCT page FROM l), rp AS (SELECT DISTINCT page FROM r),
    met AS (SELECT coalesce(lk.page, rk.page) AS page, coalesce(lk.row_y, rk.row_y) AS row_y, coalesce(lk.copies, 0) AS dec_copies, coalesce(rk.copies, 0) AS ra_copies, lk.x AS lx, rk.x AS rx FROM lk FULL JOIN rk ON lk.page = rk.page AND lk.row_y = rk.row_y),
    records AS (SELECT *, CASE WHEN dec_copies > 1 OR ra_copies > 1 THEN 'PAIRING_UNRESOLVED' WHEN dec_copies > 0 AND ra_copies > 0 THEN 'PAIRED'
            WHEN dec_copies > 0 THEN CASE WHEN page IN (FROM rp) THEN 'UNPAIRED_DEC_ONLY' ELSE 'PAGE_MISSING_ON_OTHER_SIDE' END
            ELSE CASE WHEN page IN (FROM lp) THEN 'UNPAIRED_RA_ONLY' ELSE 'PAGE_MISSING_ON_OTHER_SIDE' END END AS pairing_verdict FROM met),
    full_records AS (SELECT *, CASE WHEN pairing_verdict = 'PAIRED' THEN CASE WHEN lx.idx IS NOT DISTINCT FROM rx.idx THEN 'AGREE' ELSE 'DIFFER' END END AS row_index_agreement FROM records)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    common = [F.col("l_extendedprice").alias("value"), F.col("l_suppkey").alias("supplier"), F.struct(*_ORDER).alias("line_no")]
    idx = (F.col("l_partkey") % 4).cast("int")
    left = lines.where("l_orderkey % 17 <> 0").select(F.col("l_orderkey").alias("page"), F.when(~((F.col("l_orderkey") % 13 == 0) & (F.col("l_returnflag") == "R")), F.col("l_linenumber")).alias("row_y"), idx.alias("idx"), *common)
    right = lines.where("l_quantity <= 35 and l_orderkey % 7 <> 0").select(
        F.col("l_orderkey").alias("page"), F.when(~((F.col("l_orderkey") % 11 == 0) & (F.col("l_returnflag") == "A")), F.col("l_linenumber")).alias("row_y"), F.when(F.col("l_quantity") < 25, idx).alias("idx"), *common
    )
    return left, right


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*sides(spark, sf_dir), SIDES)


@query(f"WITH {SIDES_SQL} SELECT pairing_verdict, count(*) AS n FROM records GROUP BY pairing_verdict")
def reconcile_verdicts(spark, sf_dir):
    return reconcile.verdict_counts(records(spark, sf_dir))


@query(
    f"""WITH {SIDES_SQL} SELECT page, row_y, CASE WHEN dec_copies > 0 THEN lx.supplier ELSE rx.supplier END AS supplier, pairing_verdict, row_index_agreement, 'join_radec_v1' AS joiner_version,
        CASE WHEN pairing_verdict = 'PAIRING_UNRESOLVED' THEN 'row_y appears more than once on this page'
            WHEN row_index_agreement = 'DIFFER' THEN format('row_index differs between sides ({{}} vs {{}}); pairing is by geometry, the index disagreement is recorded only', coalesce(lx.idx::VARCHAR, 'None'), coalesce(rx.idx::VARCHAR, 'None'))
            WHEN pairing_verdict = 'PAIRED' THEN NULL
            WHEN pairing_verdict = 'PAGE_MISSING_ON_OTHER_SIDE' THEN CASE WHEN dec_copies > 0 THEN 'page absent from the RA side' ELSE 'page absent from the DEC side' END
            ELSE CASE WHEN dec_copies > 0 THEN 'no RA row with this exact row_y on this page' ELSE 'no DEC row with this exact row_y on this page' END END AS pairing_reason,
        lx.idx AS dec_idx, lx.value AS dec_value, rx.idx AS ra_idx, rx.value AS ra_value, dec_copies, ra_copies FROM full_records"""
)
def reconcile_rows(spark, sf_dir):
    flat = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("dec", "ra") for c in ("idx", "value")]
    return records(spark, sf_dir).select("page", "row_y", "supplier", "pairing_verdict", "row_index_agreement", "joiner_version", "pairing_reason", *flat, "dec_copies", "ra_copies")


@query(
    f"""WITH {SIDES_SQL} SELECT count(*) FILTER (dec_copies > 0) AS dec_rows_indexed, count(*) FILTER (ra_copies > 0) AS ra_rows_indexed, count(*) FILTER (dec_copies > 1) AS duplicate_row_y_dec, count(*) FILTER (ra_copies > 1) AS duplicate_row_y_ra,
        count(*) FILTER (pairing_verdict = 'PAIRED') AS n_paired, count(*) FILTER (pairing_verdict = 'PAIRING_UNRESOLVED') AS n_pairing_unresolved, count(*) FILTER (pairing_verdict = 'UNPAIRED_DEC_ONLY') AS n_unpaired_dec_only,
        count(*) FILTER (pairing_verdict = 'UNPAIRED_RA_ONLY') AS n_unpaired_ra_only, count(*) FILTER (pairing_verdict = 'PAGE_MISSING_ON_OTHER_SIDE') AS n_page_missing_on_other_side,
        count(*) FILTER (row_index_agreement = 'DIFFER') AS row_index_disagreements_among_paired,
        (SELECT count(*) FROM l WHERE row_y IS NULL) AS dec_page_level_records_skipped, (SELECT count(*) FROM r WHERE row_y IS NULL) AS ra_page_level_records_skipped,
        (SELECT count(*) FROM lp) AS pages_dec, (SELECT count(*) FROM rp) AS pages_ra, (SELECT count(*) FROM (FROM lp UNION FROM rp) AS u) AS pages_either_side,
        (SELECT count(*) FROM (FROM lp EXCEPT FROM rp) AS u) AS n_pages_only_dec, (SELECT count(*) FROM (FROM rp EXCEPT FROM lp) AS u) AS n_pages_only_ra
    FROM full_records"""
)
def reconcile_summary(spark, sf_dir):
    return reconcile.summary(*sides(spark, sf_dir), SIDES)


@query(
    f"""WITH {SIDES_SQL} SELECT page, count(*) FILTER (pairing_verdict = 'PAIRED') AS paired, count(*) FILTER (pairing_verdict = 'PAIRING_UNRESOLVED') AS pairing_unresolved, count(*) FILTER (pairing_verdict = 'UNPAIRED_DEC_ONLY') AS unpaired_dec_only,
        count(*) FILTER (pairing_verdict = 'UNPAIRED_RA_ONLY') AS unpaired_ra_only, count(*) FILTER (pairing_verdict = 'PAGE_MISSING_ON_OTHER_SIDE') AS page_missing_on_other_side FROM records GROUP BY page"""
)
def reconcile_per_page(spark, sf_dir):
    return reconcile.per_page_counts(records(spark, sf_dir))


@query(f"WITH {SIDES_SQL} SELECT page, 'dec' AS side FROM (FROM lp EXCEPT FROM rp) AS a UNION ALL SELECT page, 'ra' FROM (FROM rp EXCEPT FROM lp) AS b")
def pages_of_one_side(spark, sf_dir):
    return reconcile.pages_of_one_side(*sides(spark, sf_dir), SIDES)


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return reconcile.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber, x.l_extendedprice AS l_extendedprice FROM (SELECT l_orderkey, l_linenumber, arg_max({{'l_extendedprice': l_extendedprice}}, ROW({', '.join(_ORDER)})) AS x FROM lineitem GROUP BY ALL) AS y")
def last_write_wins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.struct(*_ORDER).alias("ord"))
    return reconcile.last_of_each_key(lines, ["l_orderkey", "l_linenumber"], "ord").drop("ord")


@query("SELECT doc_id, TRUE AS in_a, doc_id IN (SELECT doc_id FROM labels) AS in_b FROM documents")
def presence_documents_labels(spark, sf_dir):
    return sets.presence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, bool_and(a IS NOT NULL AND b IS NOT NULL) AS equal FROM (SELECT DISTINCT n_nationkey AS a FROM nation) AS x FULL JOIN (SELECT DISTINCT c_nationkey AS b FROM customer WHERE c_acctbal > 9000) AS y ON a = b")
def set_equality(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return sets.equal_sets(nations, table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), "k")


def _parts(spark, sf_dir):
    """Part numbers that are there, and the least and the greatest of the whole table."""
    parts = table(spark, sf_dir, "part")
    ends = parts.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return parts.where("p_size > 10"), *((1, 0) if ends[0] is None else ends)


@query("SELECT n AS number FROM (SELECT unnest(generate_series(min(p_partkey), max(p_partkey))) AS n FROM part) AS g WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_numbers(spark, sf_dir):
    parts, first, last = _parts(spark, sf_dir)
    return sets.missing_numbers(parts.select(F.col("p_partkey").alias("number")), "number", first, last)


@query(
    """
    SELECT min(n) AS first, max(n) AS last, count(*) AS n FROM (SELECT n, n - row_number() OVER (ORDER BY n) AS island FROM (SELECT unnest(generate_series(min(p_partkey), max(p_partkey))) AS n FROM part) AS g WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS x GROUP BY island"""
)
def missing_ranges(spark, sf_dir):
    parts, first, last = _parts(spark, sf_dir)
    return sets.missing_ranges(parts, "p_partkey", first, last)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') ORDER BY o_orderkey LIMIT 500")
def resume_todo(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return integrity.first_attempts(integrity.todo(orders, done, "o_orderkey"), "o_orderkey", 500)


@query("SELECT DISTINCT l_orderkey AS page FROM lineitem WHERE l_returnflag = 'N' ORDER BY page")
def done_in_order(spark, sf_dir):
    return integrity.done_in_order(table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("page")))


@query("SELECT o_orderkey, o_totalprice > 100000 AS ok FROM orders WHERE o_orderkey <= (SELECT max(k) FROM (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 300) AS x)")
def attempts_to_successes(spark, sf_dir):
    """Attempts in order up to the three hundredth that succeeded."""
    return integrity.first_successes(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("ok")), "o_orderkey", 300)


@query(
    """
    SELECT e.doc_id, e.quality, CASE WHEN g.quality IS NULL THEN 'NO ROW AT THIS KEY' WHEN g.quality = e.quality THEN 'MATCH' ELSE 'DIFFERENT' END AS outcome
    FROM (SELECT DISTINCT doc_id, quality FROM labels) AS e LEFT JOIN (SELECT doc_id, (n_chars > 1000)::INTEGER AS quality FROM documents WHERE doc_id % 10 <> 0) AS g USING (doc_id)"""
)
def golden_compare(spark, sf_dir):
    expected = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    produced = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"))
    return profile.golden_compare(expected, produced, ["doc_id"], ["quality"], "doc_id")


@query(
    """
    WITH o AS (SELECT CASE WHEN g.doc_id IS NULL THEN 'UNPAIRED' WHEN g.value IS NULL THEN g.state WHEN NOT g.ok THEN 'STRUCTURALLY_INVALID' WHEN g.value = l.value THEN 'CORRECT_TRANSCRIPTION' ELSE 'INCORRECT_TRANSCRIPTION' END AS outcome
        FROM (SELECT doc_id, quality AS value FROM labels) AS l LEFT JOIN (SELECT doc_id, CASE WHEN n_chars % 7 <> 0 THEN (n_chars > 1000)::INTEGER END AS value, CASE WHEN n_chars % 7 <> 0 THEN 'TRANSCRIBED' WHEN n_chars % 2 = 0 THEN 'UNREADABLE' ELSE 'MANUAL_REVIEW_REQUIRED' END AS state, n_chars < 5000 AS ok FROM documents WHERE doc_id % 10 <> 0) AS g USING (doc_id)),
    c AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'CORRECT_TRANSCRIPTION') AS correct_transcription, count(*) FILTER (outcome = 'INCORRECT_TRANSCRIPTION') AS incorrect_transcription, count(*) FILTER (outcome = 'STRUCTURALLY_INVALID') AS structurally_invalid,
        count(*) FILTER (outcome = 'MANUAL_REVIEW_REQUIRED') AS manual_review_required, count(*) FILTER (outcome = 'UNREADABLE') AS unreadable, count(*) FILTER (outcome = 'UNPAIRED') AS unpaired FROM o)
    SELECT *, round((correct_transcription + incorrect_transcription + structurally_invalid) * 100.0 / n, 1) AS coverage, round(correct_transcription * 100.0 / (correct_transcription + incorrect_transcription + structurally_invalid), 1) AS accuracy_numeric,
        round(correct_transcription * 100.0 / (correct_transcription + incorrect_transcription), 1) AS accuracy_admissible FROM c"""
)
def validation_metrics(spark, sf_dir):
    n = F.col("n_chars")
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"))
    rows = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select("doc_id", F.when(n % 7 != 0, (n > 1000).cast("int")).alias("value"), F.when(n % 7 != 0, "TRANSCRIBED").when(n % 2 == 0, "UNREADABLE").otherwise("MANUAL_REVIEW_REQUIRED").alias("state"), n)
    return profile.validation_metrics(profile.validation_outcomes(truth, rows, ["doc_id"], admissible=n < 5000))


QUERIES, ORACLE_SQL = query.queries, query.sql
