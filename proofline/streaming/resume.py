"""Resumable runs over growing sources: a stream of files, processed as far as there are any, that writes each page once.

Rows are kept by batch: a batch that is repeated replaces what it wrote, and of a page that several batches have the last one's rows count. So there are as many files as batches have tasks, however many pages there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import BATCH, replace_batch
from .progress import ProgressTable


def resume(
    spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet", progress: str | None = None, total: int | None = None, files_at_once: int | None = None
) -> StreamingQuery:
    """Takes the files of source that no earlier run took, applies work, and writes its rows by batch. A batch that is repeated after a failure replaces its own rows.

    progress: where to append a row after each batch, with the rate and, given a total, the time left (`progress.ProgressTable`); files_at_once: files of a batch, all by default.
    checkpoint and out are to be in storage that all executors share. Returns the query, to be awaited.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    stream = (reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)).load(source)

    def write(batch: DataFrame, number: int) -> None:
        replace_batch(work(batch), out, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if progress is not None:
        name = f"resume-{uuid.uuid4().hex}"
        spark.streams.addListener(ProgressTable(spark, progress, name, total))
        writer = writer.queryName(name)
    return writer.start()


def latest(spark: SparkSession, out: str, *page: str) -> DataFrame:
    """The rows of every page (the columns that name it, folder and page by default), those of the last batch that has it."""
    page = page or ("folder", "page")
    rows = spark.read.parquet(out)
    last = rows.groupBy(*page).agg(F.max(BATCH).alias("_last")).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(page)], "_last")
    same = F.col(BATCH) == F.col("_last")
    for i, c in enumerate(page):
        same &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    return rows.join(last, same, "left_semi").drop(BATCH)


def done_pages(spark: SparkSession, out: str, page: str = "page") -> DataFrame:
    """The pages that are written."""
    return spark.read.parquet(out).select(F.col(page).cast("string").alias(page)).distinct()
