"""A run over a population of pages, end to end: fetch, verify, extract, vote, gate, number, note where it all comes from, write once, mark done.

A page that fails anywhere becomes a failure row with the step and what went wrong, is never marked done, and so comes again; the run goes on. Each run appends its rows under its own mark, and a page's rows are those of the run that
marked it done, so that a run which was cut off leaves nothing that counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import LEAST_BYTES, require_no_drift, todo, verified_pages
from ..operators.rows import indexed_rows, voted_rows, with_provenance
from ..sources import sinks
from ..sources.fetch import PAUSE_S, TRIES, fetched, get
from ..sources.kernel import PAGE, RA, Engine, Layout, page_rows, transcribed
from ..sources.records import images
from ..sources.tables import parquet_if_any, remove


@dataclass(frozen=True)
class PageRead:
    """What was read on a page: rows of (first and last pixel row, raw reads), in any order; a state instead of rows, such as RA_COLUMN_UNRESOLVED; and the field's pixel columns. A page without rows and state has no record."""

    rows: list[tuple[list[int], list[str]]] = field(default_factory=list)
    state: str | None = None
    columns: tuple[int, int] | None = None


#: Gets a page's bytes and gives what it reads, or its rows alone.
ReadPage = Callable[[bytes], PageRead | list[tuple[list[int], list[str]]]]
#: Gets pages (page, content) and a folder for files of its own, and gives a kernel.PAGE record for each of them.
Reader = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Run:
    """Where a run writes, below out: rows, attempts, failures, done. kind: dec or ra; provenance: constant columns of its rows, such as transport and the tools' names and hashes.

    tools: (expected, found) tables of tool hashes (name, sha256); a run whose tools have changed raises before it writes anything.
    """

    out: str
    kind: str
    provenance: dict[str, str | Column] = field(default_factory=dict)
    least_bytes: int = LEAST_BYTES
    tools: tuple[DataFrame, DataFrame] | None = None


def by_bytes(read_page: ReadPage) -> Reader:
    """A reader that calls a function for each page; whatever it raises is that page's failure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for page, content in zip(f["page"], f["content"]):
                try:
                    read = read_page(content)
                    read = read if isinstance(read, PageRead) else PageRead(read)
                    rows = [] if read.state else [{"row_y": list(y), "raw_reads": list(reads)} for y, reads in read.rows]
                    made.append((page, read.state, read.columns and list(read.columns), rows, None, None))
                except Exception as e:  # whatever an engine raises is this page's failure, not the run's
                    made.append((page, None, None, [], "EXTRACTION", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(made, columns=["page", "page_state", "ra_column", "rows", "failure", "detail"])

    return lambda pages, work: pages.select("page", "content").mapInPandas(run, PAGE)


def by_images(engine: Engine, layout: Layout = RA) -> Reader:
    """A reader of page images: what was fetched is put down as files, which Spark's image source decodes, once each; the run removes them with its folder. Bytes that are no image have the state SOURCE_INPUT_INVALID."""

    def read(pages: DataFrame, work: str) -> DataFrame:
        folder = f"{work}/images"

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = pyarrow.fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            for b in batches:
                for page, content in zip(b.column(0).to_pylist(), b.column(1)):
                    # A task that runs again writes the same bytes under the same name.
                    with store.open_output_stream(f"{path}/{page.encode().hex()}.image") as f:
                        f.write(content.as_buffer())
                yield pa.RecordBatch.from_arrays([b.column(0)], ["page"])

        spark = pages.sparkSession
        put_down = pages.select("page", "content").mapInArrow(put, "page string")
        if put_down.agg(F.count("page")).first()[0] == 0:
            return spark.createDataFrame([], PAGE)
        named = images(spark, folder, all_=True).withColumn("page", F.decode(F.unhex("page"), "UTF-8"))
        return transcribed(named, engine, layout)

    return read


def done_pages(spark: SparkSession, out: str) -> DataFrame:
    """(page, attempt): what earlier runs finished, and in which."""
    return parquet_if_any(spark, f"{out}/done", "page string, attempt string")


def rows_of(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all pages that are done, those of the run that marked them, with line_no, their order within a page. What a run that was cut off has left isn't among them, nor is anything of a page that isn't done."""
    rows = spark.read.parquet(f"{out}/rows")
    return rows.join(done_pages(spark, out), ["page", "attempt"], "left_semi").withColumn("line_no", F.struct("attempt", "row_index"))


def run_pages(population: DataFrame, manifest: DataFrame, read: ReadPage | Reader, run: Run, fetch: Callable[[str], bytes] = get, tries: int = TRIES, pause_s: float = PAUSE_S, nested: bool = False) -> DataFrame:
    """Does the pages of population (run, folder, page, source_url) that aren't done, and returns (page, ok, failure, detail) of each that was attempted. read: a function of a page's bytes, or with nested a Reader, such as by_images() gives.

    A page with rows has a row for each, with page_state null; one with a state has one row, whose row_y is null and which says so; one with neither has none. All three are done. Rows say at which pixel columns they were read.
    What is fetched and what is read is written before anything depends on it, so that no page is fetched or read twice in a run, and removed when the run ends. Rows are written before pages are marked done.
    """
    spark = population.sparkSession
    if run.tools is not None:
        require_no_drift(*run.tools)
    left = todo(population, done_pages(spark, run.out), "page")
    stamp = spark.range(1).select(F.concat_ws("-", F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS"), F.substring(F.expr("uuid()"), 1, 8))).first()[0]
    work, mark = f"{run.out}/work/{stamp}", F.lit(stamp).alias("attempt")
    named = fetched(left, fetch, tries, pause_s).withColumn("name", F.concat("page", F.lit(".jpg")))
    verified_pages(named, manifest, least_bytes=run.least_bytes).write.parquet(f"{work}/pages")
    pages = spark.read.parquet(f"{work}/pages")
    reader = read if nested else by_bytes(read)
    reader(pages.where("ok").select("page", "content"), work).write.parquet(f"{work}/reads")
    reads = spark.read.parquet(f"{work}/reads")

    broken = reads.where("failure is not null").select(F.col("page").alias("_page"), F.col("failure").alias("_failure"), F.col("detail").alias("_detail"))
    met = pages.join(broken, F.col("page") == F.col("_page"), "left")
    failure = F.coalesce("failure", "_failure")
    outcome = met.withColumns({"failure": failure, "ok": failure.isNull(), "detail": F.coalesce("detail", "_detail")}).drop("_page", "_failure", "_detail")

    facts = pages.select("page", "run", "folder", "source_url", F.col("published_sha1").alias("source_published_sha1"), "local_sha1", "local_sha256", "byte_integrity")
    rows = indexed_rows(voted_rows(page_rows(reads.where("failure is null")).drop("failure", "detail"), run.kind))
    rows = with_provenance(rows.join(facts, "page"), run.provenance)
    rows.write.parquet(f"{run.out}/rows/attempt={stamp}")
    outcome.select("page", "ok", "failure", "detail").write.parquet(f"{run.out}/attempts/attempt={stamp}")
    sinks.append_failures(outcome, f"{run.out}/failures", "content", "name")
    sinks.mark_done(outcome.select("page", "ok", mark), f"{run.out}/done", "page", "attempt")
    remove(spark, work)
    return spark.read.parquet(f"{run.out}/attempts/attempt={stamp}").select("page", "ok", "failure", "detail")


def run_in_slices(population: DataFrame, manifest: DataFrame, read: ReadPage | Reader, run: Run, slices: int, **more) -> Iterator[DataFrame]:
    """run_pages() over one slice of the population after the other, yielding each one's outcome; pages are dealt out by a hash of their names.

    After each slice a row is appended to progress, below run.out, as JSON: at, done (of the whole population, earlier runs included), failed (in this call), total, per_hour (done ones in this call) and remaining_s at that rate, null
    before anything is done. What runs on reads it while the run goes on.
    """
    spark = population.sparkSession
    total, began, failed, new = population.select("page").distinct().count(), time.time(), 0, 0
    for k in range(slices):
        outcome = run_pages(population.where(F.pmod(F.xxhash64("page"), F.lit(slices)) == k), manifest, read, run, **more)
        counts = outcome.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")).first()
        failed, new = failed + counts["failed"], new + counts["ok"]
        done, elapsed = population.select("page").distinct().join(done_pages(spark, run.out).select("page").distinct(), "page", "left_semi").count(), time.time() - began
        row = (time.time(), done, failed, total, new * 3600 / elapsed, (total - done) * elapsed / new if new else None)
        spark.createDataFrame([row], "at double, done long, failed long, total long, per_hour double, remaining_s double").coalesce(1).write.mode("append").json(f"{run.out}/progress")
        yield outcome
