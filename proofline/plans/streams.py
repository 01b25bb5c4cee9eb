"""Queries that write files and read them again, as streams and as JSON Lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.resume import latest, resume
from ..operators.reconcile import last_of_each_key
from ..sources.records import json_lines
from .registry import Registry, shared_dir, table

query = Registry()


@query("SELECT event_type, user_id % 4 AS folder, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_resume(spark, sf_dir):
    """events as a stream of files, written by page; run twice, and the second run finds nothing to do."""
    out = shared_dir(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    work = lambda batch: batch.select("event_id", "value", F.col("event_type").alias("page"), (F.col("user_id") % 4).alias("folder"))
    for _ in range(2):
        resume(spark, f"{sf_dir}/events.parquet*", schema, work, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = latest(spark, f"{out}/rows")
    return rows.groupBy(F.col("page").alias("event_type"), F.col("folder").cast("long").alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """
    WITH lines AS (SELECT o_custkey AS page, 0 AS file, o_orderkey AS place, CAST(o_totalprice AS DOUBLE) AS value FROM orders UNION ALL SELECT o_custkey, 1, o_orderkey, CAST(-o_totalprice AS DOUBLE) FROM orders WHERE o_orderkey % 3 = 0)
    SELECT page, arg_max(value, ROW(file, place)) AS value FROM lines GROUP BY page"""
)
def last_line_of_each_page(spark, sf_dir):
    """orders as two folders of JSON Lines, the later one the smaller, reread: of each page the last line counts, by folder, file and place."""
    out = shared_dir(spark, "lines")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_totalprice").cast("double").alias("value"), "o_orderkey")
    for name, part in (("0-first", orders), ("1-second", orders.where("o_orderkey % 3 = 0").withColumn("value", -F.col("value")))):
        part.orderBy("o_orderkey").select("page", "value").write.json(f"{out}/{name}")
    lines = json_lines(spark, [f"{out}/0-first", f"{out}/1-second"], "page long, value double")
    return last_of_each_key(lines, ["page"], "line_no").select("page", "value")


QUERIES, ORACLE_SQL = query.queries, query.sql
