"""From page images to rows of raw reads: where the field is, where its rows are, and what an engine reads there.

transcribe_ra() and transcribe_dec() do all of it in one pass (`kernel`). The steps are there for themselves as well, each a pass over the images of which profiles or reads come back; what is decided between them (column and bands)
is decided by the relational operators of `operators.segments`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_read
from ..operators import segments
from .kernel import DEC, PADDING, RA, VARIANTS, Engine, darkness, page_rows, transcribed
from .records import INK, LEAST_SIDE, SEARCH, _grey, images, ink_profiles

def columns_of(spark: SparkSession, path: str) -> DataFrame:
    """(page, page_state, lo, hi): the field's pixel columns on each page; page_state is SOURCE_INPUT_INVALID for what is no usable image, RA_COLUMN_UNRESOLVED where the field can't be told."""
    profiles = ink_profiles(spark, path, "x", SEARCH, strict=True)
    invalid = profiles.where("page_state is not null").select("page", "page_state").distinct()
    located = segments.locate_column(profiles.where("page_state is null"), "page", "pos", "ink")
    found = located.select("page", F.when(F.col("lo").isNull(), "RA_COLUMN_UNRESOLVED").alias("page_state"), "lo", "hi")
    return found.unionByName(invalid, allowMissingColumns=True)


def bands_of(spark: SparkSession, path: str, columns: DataFrame, from_y: int | None = None) -> DataFrame:
    """(page, start, end): bands of ink in each page's columns (page, lo, hi)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ink = (darkness(_grey(r.height, r.width, r.channels, r.data), r.lo, r.hi) > INK).mean(axis=1)
                yield pd.DataFrame({"page": r.page, "y": np.arange(len(ink)), "ink": ink})

    usable = images(spark, path).join(columns.where("lo is not null").select("page", "lo", "hi"), "page")
    return segments.row_bands(usable.mapInPandas(run, "page string, y int, ink double"), from_y=from_y)


def read_bands_of(spark: SparkSession, path: str, columns: DataFrame, bands: DataFrame, engine: Engine, variants=tuple(VARIANTS)) -> DataFrame:
    """(page, row_y, raw_reads, failure, detail): what the engine reads in each band, once for each variant, white space trimmed. A page's bands are no more than fit on it.

    A page on which the engine raises has one row without reads, whose failure is EXTRACTION and whose detail tells the error; the others go on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                dark = darkness(_grey(r.height, r.width, r.channels, r.data), r.lo, r.hi)
                rows = []
                try:
                    for y0, y1 in ((b["start"], b["end"]) for b in r.bands):
                        part = dark[max(0, y0 - PADDING) : y1 + PADDING]
                        rows.append((r.page, [int(y0), int(y1)], [engine(np.where(part > v[2], 0, 255).astype(np.uint8), v) for v in variants], None, None))
                except Exception as e:  # whatever an engine raises is this page's failure, not the job's
                    rows = [(r.page, None, None, "EXTRACTION", f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["page", "row_y", "raw_reads", "failure", "detail"])

    gathered = bands.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("bands"))
    todo = images(spark, path).join(columns.select("page", "lo", "hi"), "page").join(gathered, "page")
    read = todo.mapInPandas(run, "page string, row_y array<int>, raw_reads array<string>, failure string, detail string")
    return read.withColumn("raw_reads", F.transform("raw_reads", clean_read))


def transcribe_ra(spark: SparkSession, path: str, engine: Engine) -> DataFrame:
    """(page, page_state, ra_column, row_y, raw_reads, failure, detail): a row for each band below the header of each page, and a page-level one (row_y null) for pages with a page_state or a failure. A page without bands has no row. Images are read once."""
    return page_rows(transcribed(images(spark, path, all_=True), engine, RA))


def transcribe_dec(spark: SparkSession, path: str, engine: Engine) -> DataFrame:
    """(page, row_y, raw_reads, failure, detail): a row for each band of each image in the fixed declination columns, the header's too. Images of any size are read, others that can't be decoded have none. Images are read once."""
    return page_rows(transcribed(images(spark, path), engine, DEC)).select("page", "row_y", "raw_reads", "failure", "detail")


__all__ = ["LEAST_SIDE", "VARIANTS", "bands_of", "columns_of", "read_bands_of", "transcribe_dec", "transcribe_ra"]
