"""Sinks: records, failures, done pages and summaries, so written that a page done twice is there once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_pages(rows: DataFrame, path: str, folder: str = "folder", page: str = "page") -> None:
    """Writes rows partitioned by folder and page; a page that is written again replaces what it had, so that an interrupted run can be repeated safely."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder, page).parquet(path)


#: The column that says which batch wrote a row.
BATCH = "batch_number"


def replace_batch(rows: DataFrame, path: str, number: int) -> None:
    """Writes a batch's rows below a folder of its own; a batch that is written again replaces what it had, and no other's. Unlike replace_pages() this makes no folder for each page."""
    rows.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def append_failures(verified: DataFrame, path: str, *payload: str) -> None:
    """Appends what failed, without payload columns, as JSON Lines."""
    verified.where(~F.col("ok")).drop(*payload).write.mode("append").json(path)


def mark_done(verified: DataFrame, path: str, page: str = "page", *also: str) -> None:
    """Appends the pages that succeeded, with further columns; a page that failed is never marked and so is tried again."""
    verified.where("ok").select(page, *also).distinct().write.mode("append").parquet(path)


def write_joined(ordered: DataFrame, summary: DataFrame, path: str) -> None:
    """Joined records in output order and their summary, as JSON."""
    ordered.write.mode("errorifexists").json(f"{path}/rows")
    summary.write.mode("errorifexists").json(f"{path}/summary")


def progress_metrics() -> list[Column]:
    """How many rows pass, and how many of them failed (ok is false; null is no failure)."""
    return [F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(F.col("ok"), F.lit(True))).alias("failed")]


def observed(rows: DataFrame, name: str = "progress") -> DataFrame:
    """rows with progress_metrics() under a name, by which a query listener gets them while a stream runs. What time is left is told by profile.throughput from the attempts' times."""
    return rows.observe(name, *progress_metrics())


def extractor_json(rows: DataFrame, page: str = "page", fields: tuple[str, ...] = ("row_y", "raw_reads", "normalised", "state", "value")) -> DataFrame:
    """(page, json): one JSON object a page with its rows in order; a page's rows are no more than fit on it."""
    gathered = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    return gathered.select(page, F.to_json(F.struct("rows"), {"ignoreNullFields": "false"}).alias("json"))
