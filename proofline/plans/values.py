"""Queries on values: populations, reads, consensus, gates, coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import domain_violations, facts
from ..functions.consensus import consensus
from ..functions.eligibility import DEC_WINDOW, eligibility, in_date_window, in_dec_window, in_frequency_window
from ..functions.epoch import E_TERMS, MATRIX, b1950_to_j2000
from ..functions.sexagesimal import dec_arcminutes, edge_distance, normalise_dec, normalise_ra, parse_dec, parse_ra, ra_seconds
from ..functions.text import clean_read, page_class, printed_date, rescaled, tokens
from ..operators import profile
from ..operators.gates import DEC_VERSION, gate_dec_rows, gate_ra_rows
from ..operators.rows import in_scope, indexed_rows, voted_rows, with_provenance
from ..sources.records import population
from .registry import Registry, table

query = Registry()

# Text forms that reads come in, made from an order's numbers.
READS_SQL = """
    SELECT o_orderkey, CASE o_orderkey % 6
        WHEN 0 THEN printf('%02d %02d', o_custkey % 100, o_orderkey % 100)
        WHEN 1 THEN printf('%02d%02d', o_custkey % 100, o_orderkey % 100)
        WHEN 2 THEN printf('-%02d %02d', o_custkey % 100, o_orderkey % 100)
        WHEN 3 THEN printf('%02d %02d %02d', o_custkey % 30, o_orderkey % 70, o_custkey % 70)
        WHEN 4 THEN printf('%02d%02d%02d', o_custkey % 30, o_orderkey % 70, o_custkey % 70)
        ELSE printf('%d:%d', o_custkey % 100, o_orderkey % 100) END AS read
    FROM orders"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, h, m, s = [F.col(c) % n for c, n in (("o_custkey", 100), ("o_orderkey", 100), ("o_custkey", 30), ("o_orderkey", 70), ("o_custkey", 70))]
    kind = F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.format_string("%02d %02d", a, b))
        .when(kind == 1, F.format_string("%02d%02d", a, b))
        .when(kind == 2, F.format_string("-%02d %02d", a, b))
        .when(kind == 3, F.format_string("%02d %02d %02d", h, m, s))
        .when(kind == 4, F.format_string("%02d%02d%02d", h, m, s))
        .otherwise(F.format_string("%d:%d", a, b))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("read"))


NORMALISED_SQL = f"""
    SELECT o_orderkey,
        CASE WHEN len(g) = 2 AND len(g[1]) = 2 AND len(g[2]) = 2 THEN '-' || g[1] || ' ' || g[2]
            WHEN len(g) = 1 AND len(g[1]) = 4 THEN '-' || g[1][1:2] || ' ' || g[1][3:4] END AS dec,
        CASE WHEN len(g) = 3 AND len(g[1]) = 2 AND len(g[2]) = 2 AND len(g[3]) = 2 THEN g[1] || ' ' || g[2] || ' ' || g[3]
            WHEN len(g) = 1 AND len(g[1]) = 6 THEN g[1][1:2] || ' ' || g[1][3:4] || ' ' || g[1][5:6] END AS ra
    FROM (SELECT o_orderkey, regexp_extract_all(read, '([0-9]+)', 1) AS g FROM ({READS_SQL}) AS r) AS x"""


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("o_orderkey", normalise_dec(F.col("read")).alias("dec"), normalise_ra(F.col("read")).alias("ra"))


@query(
    """
    SELECT run, folder, n, printf('%s-%03d', folder, n) AS page
    FROM (SELECT printf('R-%02d', n_nationkey) AS run, printf('%03d', n_regionkey) AS folder,
            unnest(generate_series(n_nationkey * 3, n_nationkey * 3 + n_nationkey % 7 - 1))::INTEGER AS n FROM nation) AS x"""
)
def population_pages(spark, sf_dir):
    k = F.col("n_nationkey")
    runs = table(spark, sf_dir, "nation").select(F.format_string("R-%02d", k).alias("run"), F.format_string("%03d", F.col("n_regionkey")).alias("folder"), (k * 3).alias("first"), (k * 3 + k % 7 - 1).alias("last"))
    return population(runs)


@query(NORMALISED_SQL)
def normalise_reads(spark, sf_dir):
    return normalised(spark, sf_dir)


@query(
    """
    SELECT doc_id, len(regexp_extract_all(text, '([0-9]+)', 1))::INTEGER AS n_groups,
        len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))::INTEGER AS n_tokens
    FROM documents"""
)
def digit_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("n_groups"), F.size(tokens(F.col("text"))).alias("n_tokens"))


@query(
    """
    SELECT conv_id, turn, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS read FROM conversations"""
)
def cleaned_reads(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", clean_read(F.col("text")).alias("read"))


@query(
    f"""
    SELECT o_orderkey, CASE WHEN regexp_full_match(dec, '-[0-9]{{2}} [0-9]{{2}}') THEN -(dec[2:3]::INTEGER * 60 + dec[5:6]::INTEGER) END AS arcminutes,
        CASE WHEN regexp_full_match(ra, '[0-9]{{2}} [0-9]{{2}} [0-9]{{2}}') THEN ra[1:2]::INTEGER * 3600 + ra[4:5]::INTEGER * 60 + ra[7:8]::INTEGER END AS seconds
    FROM ({NORMALISED_SQL}) AS n"""
)
def parsed_coordinates(spark, sf_dir):
    return normalised(spark, sf_dir).select("o_orderkey", dec_arcminutes(F.col("dec")).alias("arcminutes"), ra_seconds(F.col("ra")).alias("seconds"))


THREE_SQL = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE printf('-%02d %02d', o_orderkey % 36, o_custkey % 70) END AS a,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN printf('-%02d %02d', o_orderkey % 35, o_custkey % 69) ELSE printf('-%02d %02d', o_orderkey % 36, o_custkey % 70) END AS b,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN printf('-%02d %02d', o_orderkey % 36, o_custkey % 70) ELSE printf('-%02d %02d', o_orderkey % 34, o_custkey % 68) END AS c
    FROM orders"""
CONSENSUS_SQL = f"""
    SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'UNREADABLE' WHEN a = b OR a = c OR b = c THEN 'TRANSCRIBED' ELSE 'MANUAL_REVIEW_REQUIRED' END AS state,
        CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS value
    FROM ({THREE_SQL}) AS t"""


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    form = lambda x, y: F.format_string("-%02d %02d", k % x, c % y)
    three = [F.when(k % 5 != 0, form(36, 70)), F.when(k % 4 == 0, F.lit(None)).when(k % 3 == 0, form(35, 69)).otherwise(form(36, 70)), F.when(k % 10 == 0, F.lit(None)).when(c % 2 == 0, form(36, 70)).otherwise(form(34, 68))]
    vote = consensus(F.array(*three))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", vote.alias("v")).select("o_orderkey", "o_custkey", "v.state", "v.value")


@query(CONSENSUS_SQL)
def consensus_vote(spark, sf_dir):
    return voted(spark, sf_dir).drop("o_custkey")


GATE_DEC_SQL = f"""
    SELECT *, '{DEC_VERSION}' AS gate_version, CASE WHEN value IS NULL THEN 'UNREADABLE' WHEN d IS NULL OR m >= 60 OR d NOT BETWEEN 20 AND 35 THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'STRUCTURALLY_ADMISSIBLE' END AS gate_state,
        CASE WHEN value IS NULL THEN 'extractor produced no value' WHEN d IS NULL THEN 'value does not parse as two two-digit groups'
            WHEN m >= 60 THEN printf('arcminute component %d is not a valid sexagesimal minute', m)
            WHEN d NOT BETWEEN 20 AND 35 THEN printf('degree component -%d lies outside the declared plausible band', d)
            ELSE 'value is a possible coordinate' END AS gate_reason
    FROM (SELECT o_orderkey, state, value, CASE WHEN regexp_full_match(value, '-[0-9]{{2}} [0-9]{{2}}') THEN value[2:3]::INTEGER END AS d,
            CASE WHEN regexp_full_match(value, '-[0-9]{{2}} [0-9]{{2}}') THEN value[5:6]::INTEGER END AS m FROM ({CONSENSUS_SQL}) AS v) AS g"""


def gated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_dec_rows(voted(spark, sf_dir))


@query(f"SELECT o_orderkey, state, value, gate_state, gate_reason, gate_version FROM ({GATE_DEC_SQL}) AS g")
def gate_dec(spark, sf_dir):
    return gated_orders(spark, sf_dir).drop("o_custkey")


@query(
    f"""
    SELECT o_orderkey, ra AS value, 'ra_validity_gate_v1' AS gate_version,
        CASE WHEN ra IS NULL THEN 'UNREADABLE' WHEN h > 23 OR m > 59 OR s > 59 THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'STRUCTURALLY_ADMISSIBLE' END AS gate_state,
        CASE WHEN ra IS NULL THEN 'extractor produced no value' WHEN h > 23 THEN printf('hour component %d is outside 0 to 23', h) WHEN m > 59 THEN printf('minute component %d is outside 0 to 59', m)
            WHEN s > 59 THEN printf('second component %d is outside 0 to 59', s) ELSE 'value is a possible right ascension' END AS gate_reason
    FROM (SELECT *, ra[1:2]::INTEGER AS h, ra[4:5]::INTEGER AS m, ra[7:8]::INTEGER AS s FROM ({NORMALISED_SQL}) AS n) AS x"""
)
def gate_ra(spark, sf_dir):
    return gate_ra_rows(normalised(spark, sf_dir).select("o_orderkey", F.col("ra").alias("value")))


@query(f"SELECT gate_state, gate_reason, count(*) AS n FROM ({GATE_DEC_SQL}) AS g GROUP BY ALL")
def gate_reason_counts(spark, sf_dir):
    return gated_orders(spark, sf_dir).groupBy("gate_state", "gate_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT state, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM ({CONSENSUS_SQL}) AS v GROUP BY state")
def state_distribution(spark, sf_dir):
    return profile.state_distribution(voted(spark, sf_dir), "state")


@query(f"SELECT split_part(value, ' ', 1) AS component, count(*) AS n FROM ({CONSENSUS_SQL}) AS v WHERE value IS NOT NULL GROUP BY 1")
def component_histogram(spark, sf_dir):
    return profile.component_histogram(voted(spark, sf_dir), "value")


@query(
    f"""
    SELECT count(DISTINCT CASE WHEN bad THEN value END) AS distinct_invalid, count(*) FILTER (bad) AS invalid_rows, round(count(*) FILTER (bad) * 100.0 / nullif(count(*) FILTER (state = 'TRANSCRIBED'), 0), 2) AS share_percent
    FROM (SELECT *, state = 'TRANSCRIBED' AND gate_state = 'MANUAL_REVIEW_REQUIRED' AS bad FROM ({GATE_DEC_SQL}) AS g) AS x"""
)
def invalid_profile(spark, sf_dir):
    return profile.invalid_profile(gated_orders(spark, sf_dir), "value", F.col("state") == "TRANSCRIBED", F.col("gate_state") == "MANUAL_REVIEW_REQUIRED")


@query(
    f"""
    SELECT (o_orderkey % 97)::INTEGER AS page, max(d * 60 + m) - min(d * 60 + m) AS span FROM ({GATE_DEC_SQL}) AS g WHERE gate_state = 'STRUCTURALLY_ADMISSIBLE' GROUP BY 1"""
)
def run_span(spark, sf_dir):
    rows = gated_orders(spark, sf_dir).where("gate_state = 'STRUCTURALLY_ADMISSIBLE'")
    return profile.run_span(rows.select((F.col("o_orderkey") % 97).cast("int").alias("page"), dec_arcminutes(F.col("value")).alias("v")), "page", "v")


_BAND_SQL = f"""
    SELECT o_custkey AS page, [o_orderkey::INTEGER, o_orderkey::INTEGER + 15] AS row_y, state AS extractor_state, value AS extractor_value, gate_state, gate_reason, gate_version, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS row_index,
        'PLAIN' AS transport, 'UNESTABLISHED' AS source_authenticity
    FROM (SELECT o_orderkey, o_custkey, g.* EXCLUDE (o_orderkey) FROM ({GATE_DEC_SQL}) AS g JOIN (SELECT o_orderkey, o_custkey FROM orders) AS o USING (o_orderkey)) AS x"""


@query(_BAND_SQL)
def extracted_rows(spark, sf_dir):
    """Raw reads of each order's band taken all the way to gated row records."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    form = lambda x, y: F.format_string(" %02d %02d\n", k % x, c % y)
    reads = F.array(F.when(k % 5 != 0, form(36, 70)), F.when(k % 4 == 0, F.lit(None)).when(k % 3 == 0, form(35, 69)).otherwise(form(36, 70)), F.when(k % 10 == 0, F.lit(None)).when(c % 2 == 0, form(36, 70)).otherwise(form(34, 68)))
    bands = in_scope(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"]).select(c.alias("page"), F.array(k.cast("int"), k.cast("int") + 15).alias("row_y"), reads.alias("raw_reads"))
    return with_provenance(indexed_rows(voted_rows(bands, "dec")), {"transport": "PLAIN"}).drop("raw_reads", "normalised")


_RA, _DEC = "((o_orderkey % 86400) / 240.0)", "(-20.0 - (o_custkey % 900) / 60.0)"
_V = [f"cos(radians({_RA})) * cos(radians({_DEC}))", f"sin(radians({_RA})) * cos(radians({_DEC}))", f"sin(radians({_DEC}))"]
_DOT = " + ".join(f"v{i} * ({E_TERMS[i]!r})" for i in range(3))
EPOCH_SQL = f"""
    SELECT o_orderkey, round(CASE WHEN degrees(atan2(w1, w0)) < 0 THEN degrees(atan2(w1, w0)) + 360 ELSE degrees(atan2(w1, w0)) END, 6) AS ra_deg, round(degrees(atan2(w2, sqrt(w0 * w0 + w1 * w1))), 6) AS dec_deg
    FROM (SELECT o_orderkey, {", ".join(f"u0 * ({r[0]!r}) + u1 * ({r[1]!r}) + u2 * ({r[2]!r}) AS w{i}" for i, r in enumerate(MATRIX))}
        FROM (SELECT o_orderkey, {", ".join(f"v{i} - ({E_TERMS[i]!r}) + v{i} * ({_DOT}) AS u{i}" for i in range(3))}
            FROM (SELECT o_orderkey, {", ".join(f"{v} AS v{i}" for i, v in enumerate(_V))} FROM orders) AS v) AS u) AS w"""


def j2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = (F.col("o_orderkey") % 86400) / 240.0, F.lit(-20.0) - (F.col("o_custkey") % 900) / 60.0
    moved = b1950_to_j2000(ra, dec)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", moved.alias("p")).select("o_orderkey", "o_orderdate", F.round("p.ra_deg", 6).alias("ra_deg"), F.round("p.dec_deg", 6).alias("dec_deg"))


@query(EPOCH_SQL)
def epoch_transform(spark, sf_dir):
    return j2000(spark, sf_dir).drop("o_orderdate")


@query(f"SELECT o_orderkey, round(least(dec_deg - ({DEC_WINDOW[0]}), ({DEC_WINDOW[1]}) - dec_deg), 6) AS degrees FROM ({EPOCH_SQL}) AS e")
def edge_distances(spark, sf_dir):
    return j2000(spark, sf_dir).select("o_orderkey", F.round(edge_distance(F.col("dec_deg"), *DEC_WINDOW), 6).alias("degrees"))


@query(f"SELECT round(max(dec_deg) - min(dec_deg), 6) AS spread, round((max(dec_deg) - min(dec_deg)) * 100.0 / 0.666667, 2) AS percent_of_window FROM ({EPOCH_SQL}) AS e")
def shift_spread(spark, sf_dir):
    return profile.shift_spread(j2000(spark, sf_dir), "dec_deg", 0.666667).withColumn("spread", F.round("spread", 6))


@query(
    f"""
    SELECT o.o_orderkey, CASE WHEN NOT (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01') THEN 'INELIGIBLE_BY_DATE' WHEN o.o_orderkey % 9 = 0 THEN 'DECLINATION_UNKNOWN'
        WHEN dec_deg BETWEEN {DEC_WINDOW[0]} AND {DEC_WINDOW[1]} THEN 'D2_SPATIAL_ELIGIBLE' ELSE 'D2_SPATIAL_INELIGIBLE' END AS eligibility
    FROM orders AS o JOIN ({EPOCH_SQL}) AS e USING (o_orderkey)"""
)
def window_eligibility(spark, sf_dir):
    rows = j2000(spark, sf_dir)
    known = F.when(F.col("o_orderkey") % 9 != 0, in_dec_window(F.col("dec_deg")))
    return rows.select("o_orderkey", eligibility(in_date_window(F.col("o_orderdate"), "1995-01-01", "1996-12-31"), known).alias("eligibility"))


@query("SELECT user_id, count(*) FILTER (1420300 + event_id % 500 BETWEEN 1420351 AND 1420731) AS in_window, count(*) AS n FROM events GROUP BY user_id")
def frequency_window(spark, sf_dir):
    khz = F.col("event_id") % 500 + 1420300
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(in_frequency_window(khz)).alias("in_window"), F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT p_partkey, CASE WHEN contains(upper(p_type), 'STANDARD') OR contains(upper(p_type), 'ECONOMY') THEN 'x' END IS NOT NULL AS kept,
        CASE WHEN contains(t, 'DECLINATION') THEN 'HEADER_PAGE' WHEN contains(t, 'CHANNEL NUMBER') THEN 'DATA_PAGE' WHEN contains(t, 'JOB') OR contains(t, 'PAGE') THEN 'JOB_LISTING_PAGE' ELSE 'UNDETERMINED' END AS class
    FROM (SELECT *, ['DECLINATION SETTING', 'CHANNEL NUMBER 7', 'JOB 12', 'PAGE 3', p_name][1 + p_partkey % 5] AS t FROM part) AS x"""
)
def page_classes(spark, sf_dir):
    text = F.get(F.array(F.lit("DECLINATION SETTING"), F.lit("CHANNEL NUMBER 7"), F.lit("JOB 12"), F.lit("PAGE 3"), F.col("p_name")), (F.col("p_partkey") % 5).cast("int"))
    kept = F.upper("p_type").contains("STANDARD") | F.upper("p_type").contains("ECONOMY")
    return table(spark, sf_dir, "part").select("p_partkey", kept.alias("kept"), page_class(text).alias("class"))


@query("SELECT o_orderkey, try_cast(printf('%d-%02d-%02d', 1900 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) AS DATE) AS printed FROM orders")
def printed_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", printed_date(F.upper(F.date_format("o_orderdate", "d MMM yy"))).alias("printed"))


@query(
    """
    SELECT p_partkey, CASE WHEN abs(2.0 / (CASE WHEN p_partkey % 3 = 0 THEN 3.0 ELSE 2.0 END) - 1) <= 0.02 THEN (p_size * 2)::INTEGER END AS x0, CASE WHEN p_partkey % 3 <> 0 THEN (p_size * 6)::INTEGER END AS y1
    FROM part"""
)
def rescaled_rectangles(spark, sf_dir):
    size = F.col("p_size")
    rect = F.struct(size.alias("x0"), size.alias("y0"), (size * 2).alias("x1"), (size * 3).alias("y1"))
    height = F.when(F.col("p_partkey") % 3 == 0, 3000.0).otherwise(2000.0)
    r = rescaled(rect, F.lit(1000.0), F.lit(1000.0), F.lit(2000.0), height)
    return table(spark, sf_dir, "part").select("p_partkey", r["x0"].alias("x0"), r["y1"].alias("y1"))


@query(
    """
    SELECT event_id, sha256(replace(props, ' ', '')) AS canonical_sha256, TRUE AS deterministic, 0 AS n_violations FROM events"""
)
def canonical_hash(spark, sf_dir):
    """props are objects of one integer: their canonical form is the text without spaces."""
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", facts(props).alias("f")).select("event_id", F.sha2(F.col("f.canonical").cast("binary"), 256).alias("canonical_sha256"), "f.deterministic", F.size("f.violations").alias("n_violations"))


@query(
    """
    SELECT user_id, count(*) FILTER (event_id % 5 = 0)::BIGINT AS booleans, count(*) FILTER (event_id % 5 = 1)::BIGINT AS nulls, count(*) FILTER (event_id % 5 = 2)::BIGINT AS names FROM events GROUP BY user_id"""
)
def sealed_domain(spark, sf_dir):
    """Documents made to break a rule each, and how often each rule is found broken."""
    doc = F.get(F.array(F.lit('{"a": true}'), F.lit('{"a": [1, null]}'), F.lit('{"b": {"status": "x"}}'), F.lit('{"a": "x"}'), F.lit('[1, "é"]')), (F.col("event_id") % 5).cast("int"))
    found = table(spark, sf_dir, "events").select("user_id", F.array_join(domain_violations(doc), ";").alias("v"))
    count = lambda text: F.count_if(F.col("v") == text)
    return found.groupBy("user_id").agg(count("forbidden scalar type bool at $.a").alias("booleans"), count("forbidden scalar type NoneType at $.a[1]").alias("nulls"), count("forbidden field name status at $.b").alias("names"))


@query(
    f"""
    SELECT o_orderkey, regexp_full_match(value, '-[0-9]{{2}} [0-9]{{2}}') IS TRUE AS is_dec, FALSE AS is_ra FROM ({CONSENSUS_SQL}) AS v"""
)
def parse_checks(spark, sf_dir):
    v = F.col("value")
    return voted(spark, sf_dir).select("o_orderkey", parse_dec(v).isNotNull().alias("is_dec"), parse_ra(v).isNotNull().alias("is_ra"))


QUERIES, ORACLE_SQL = query.queries, query.sql
