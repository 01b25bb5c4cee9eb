"""Queries along ordered sequences: bands, separators, runs, forward fill, samples, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile, propagate, sampling, segments
from ..sources import kernel
from .registry import Registry, table

query = Registry()

# Each vector of embeddings serves as the profile of a page.
PROFILE_SQL = "SELECT vec_id AS page, (unnest(generate_series(1, len(embedding))) - 1)::INTEGER AS pos, unnest(embedding)::DOUBLE AS ink FROM embeddings"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "ink"))


def _runs_sql(on: str) -> str:
    return f"""SELECT page, min(pos) AS start, max(pos) + 1 AS "end", max(pos) = any_value(last) AS at_end FROM (
        SELECT page, pos, last, pos - row_number() OVER (PARTITION BY page ORDER BY pos) AS island FROM (SELECT *, max(pos) OVER (PARTITION BY page) AS last, max(ink) OVER (PARTITION BY page) AS top FROM ({PROFILE_SQL}) AS p) AS q WHERE {on}) AS r GROUP BY page, island"""


BANDS_SQL = f"""SELECT page, start, "end" FROM ({_runs_sql("ink > 0.0")}) AS b WHERE NOT at_end AND "end" - start BETWEEN 2 AND 5"""
SEPARATORS_SQL = f"""SELECT page, start, "end" FROM ({_runs_sql("ink <= top * 0.3")}) AS s WHERE at_end OR "end" - start >= 3"""


@query(BANDS_SQL)
def row_bands(spark, sf_dir):
    return segments.row_bands(profiles(spark, sf_dir), "page", "pos", "ink", 0.0, 2, 5)


@query(SEPARATORS_SQL)
def separators(spark, sf_dir):
    return segments.separators(profiles(spark, sf_dir), "page", "pos", "ink", 0.3, 3)


LOCATED_SQL = f"""
    WITH s AS (SELECT page, start, "end" FROM ({_runs_sql("ink <= top * 0.06")}) AS s WHERE at_end OR "end" - start >= 8),
    p AS (SELECT page, max(ink) AS top FROM ({PROFILE_SQL}) AS p GROUP BY page),
    l AS (SELECT page, arg_max("end", ROW("end" - start, -start)) AS lo FROM s WHERE "end" <= 30 GROUP BY page), r AS (SELECT page, arg_max(start, ROW("end" - start, -start)) AS hi FROM s WHERE start >= 34 GROUP BY page)
    SELECT p.page, CASE WHEN top > 0 AND hi - lo >= 4 THEN lo END AS lo, CASE WHEN top > 0 AND hi - lo >= 4 THEN hi END AS hi FROM p LEFT JOIN l ON l.page = p.page LEFT JOIN r ON r.page = p.page"""


@query(LOCATED_SQL)
def locate_column(spark, sf_dir):
    return segments.locate_column(profiles(spark, sf_dir), "page", "pos", "ink", 30, 34, 4)


@query(BANDS_SQL)
def row_bands_in_arrays(spark, sf_dir):
    """As row_bands, each profile read as an array in one pass."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.col("embedding").alias("ink"))
    return kernel.bands_of_arrays(vectors, share=0.0, shortest=2, longest=5)


@query(LOCATED_SQL)
def locate_column_in_arrays(spark, sf_dir):
    """As locate_column, each profile read as an array in one pass."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.col("embedding").alias("ink"))
    return kernel.fields_of_arrays(vectors, left_limit=30, right_limit=34, narrowest=4)


@query(f"""SELECT *, (row_number() OVER (PARTITION BY page ORDER BY start) - 1)::INTEGER AS row_index FROM ({BANDS_SQL}) AS b WHERE start >= 4""")
def row_numbering(spark, sf_dir):
    return segments.numbered_rows(segments.row_bands(profiles(spark, sf_dir), "page", "pos", "ink", 0.0, 2, 5, from_y=4))


@query("SELECT conv_id, turn, role, sum((role = 'user')::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM conversations")
def run_segments(spark, sf_dir):
    return propagate.run_segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user", chunk=256)


@query("SELECT conv_id, run, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT conv_id, turn, sum((role = 'user')::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM conversations) AS x WHERE run > 0 GROUP BY conv_id, run")
def run_spans(spark, sf_dir):
    return propagate.run_spans(run_segments(spark, sf_dir), "conv_id", "turn")


@query(
    """
    SELECT event_id, user_group, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS filled, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS source,
        CASE WHEN event_type = 'purchase' THEN 'READ_DIRECTLY' WHEN last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w IS NOT NULL THEN 'DERIVED' END AS origin
    FROM (SELECT *, user_id % 10 AS user_group FROM events) AS e WINDOW w AS (PARTITION BY user_group ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
)
def forward_fill(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("user_group"), "event_type", "value")
    return propagate.forward_fill(events, "user_group", "event_id", F.col("event_type") == "purchase", "value", chunk=512).drop("value")


@query(
    """
    SELECT p_partkey, r.run FROM part JOIN (SELECT n_nationkey AS run, n_regionkey AS k, n_nationkey * 2 AS first, n_nationkey * 2 + n_regionkey AS last FROM nation) AS r ON p_partkey % 5 = r.k AND p_size BETWEEN r.first AND r.last"""
)
def range_join_runs(spark, sf_dir):
    key = F.col("n_nationkey")
    runs = table(spark, sf_dir, "nation").select(key.alias("run"), F.col("n_regionkey").cast("long").alias("k"), (key * 2).alias("first"), (key * 2 + F.col("n_regionkey")).alias("last"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("k"))
    return propagate.range_join(parts, runs, "k", "p_size").select("p_partkey", "run")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")


RANKED_SQL = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


@query(f"SELECT * FROM (SELECT o_custkey, o_orderkey, CASE WHEN i = 0 THEN 'first' WHEN i = n - 1 THEN 'last' WHEN n >= 3 AND i = (n - 1) // 2 THEN 'middle' END AS position FROM ({RANKED_SQL}) AS r) AS s WHERE position IS NOT NULL")
def sample_first_mid_last(spark, sf_dir):
    return sampling.first_middle_last(customers(spark, sf_dir), "o_custkey", "o_orderkey")


@query(f"SELECT o_custkey, o_orderkey FROM ({RANKED_SQL}) AS r WHERE i IN ((5 * (n - 1) + 50) // 100, (22 * (n - 1) + 50) // 100, (39 * (n - 1) + 50) // 100, (56 * (n - 1) + 50) // 100, (73 * (n - 1) + 50) // 100, (90 * (n - 1) + 50) // 100)")
def sample_fractional(spark, sf_dir):
    return sampling.at_fractions(customers(spark, sf_dir), "o_custkey", "o_orderkey")


@query(f"SELECT o_custkey, o_orderkey FROM ({RANKED_SQL}) AS r WHERE i % 4 = 0")
def sample_every_kth(spark, sf_dir):
    return sampling.every_kth(customers(spark, sf_dir), "o_custkey", "o_orderkey")


@query(f"SELECT * FROM (SELECT o_custkey, o_orderkey, CASE WHEN i = 0 THEN 'low' WHEN i = n - 1 THEN 'high' WHEN i = (n - 1) // 2 THEN 'middle' WHEN i % 4 = 0 THEN 'interval' END AS chosen_as FROM ({RANKED_SQL}) AS r) AS s WHERE chosen_as IS NOT NULL")
def sample_low_middle_high(spark, sf_dir):
    return sampling.low_middle_high_and_every_kth(customers(spark, sf_dir), "o_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey = 100 THEN 0 WHEN p_partkey < 100 THEN 2 * (100 - p_partkey) - 1 ELSE 2 * (p_partkey - 100) END AS step FROM part ORDER BY step")
def order_outward(spark, sf_dir):
    return sampling.outward(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 100).orderBy("step")


@query("SELECT source, doc_id, rank::INTEGER AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('20260818|' || doc_id), doc_id) AS rank FROM documents) AS x WHERE rank <= 8")
def sample_seeded(spark, sf_dir):
    return sampling.seeded(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 8, 20260818)


@query("SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events")
def cadence(spark, sf_dir):
    return profile.cadence(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", "event_id")


QUERIES, ORACLE_SQL = query.queries, query.sql
