"""One pass over page images: each is decoded once, and what leaves a task is a record of its page, its field's columns and its rows' reads.

Profiles are arrays here and runs are found in arrays, as `operators.segments` finds them in tables of places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_read
from ..operators.segments import FIELD_MIN, HEADER_Y, LEFT_LIMIT, RIGHT_LIMIT, ROW_MAX, ROW_MIN, ROW_SHARE, SEPARATOR_MIN, SEPARATOR_SHARE
from .records import DEC_COLUMN, INK, LEAST_SIDE, SEARCH, _grey

# How a band is rendered for each of its reads (scale, page segmentation mode, darkness cut), and how far it is padded.
VARIANTS = [(4, 7, 30), (3, 7, 40), (4, 8, 22)]
PADDING = 3
INVALID, UNRESOLVED = "SOURCE_INPUT_INVALID", "RA_COLUMN_UNRESOLVED"

#: An engine gets a band as ink (0) on paper (255), and a variant; it gives the text that it reads.
Engine = Callable[[np.ndarray, tuple[int, int, int]], str]

#: A page as one nested record. failure and detail tell of an engine that raised; such a page has neither state nor rows.
PAGE = "page string, page_state string, ra_column array<int>, rows array<struct<row_y:array<int>,raw_reads:array<string>>>, failure string, detail string"
_ROWS = pa.list_(pa.struct([("row_y", pa.list_(pa.int32())), ("raw_reads", pa.list_(pa.string()))]))
_PAGE = pa.schema([("page", pa.string()), ("page_state", pa.string()), ("ra_column", pa.list_(pa.int32())), ("rows", _ROWS), ("failure", pa.string()), ("detail", pa.string())])


def runs_of(on: np.ndarray, at: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, at_end) of maximal runs of consecutive places where on holds, half open. at: the places in order, 0 and up by default; a place that is absent ends a run. at_end: the run reaches the last place."""
    at = np.arange(len(on)) if at is None else at
    held = np.flatnonzero(on)
    if not len(held):
        return []
    cuts = np.flatnonzero(np.diff(at[held]) != 1)
    starts, ends = at[held[np.r_[0, cuts + 1]]], at[held[np.r_[cuts, len(held) - 1]]] + 1
    return [(a, b, b > at[-1]) for a, b in zip(starts.tolist(), ends.tolist())]


def bands(ink: np.ndarray, share: float = ROW_SHARE, shortest: int = ROW_MIN, longest: int = ROW_MAX, from_y: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of bands of ink above share, of a height within bounds, that don't reach the last pixel and don't begin above from_y."""
    return [(a, b) for a, b, open_ in runs_of(ink > share) if not open_ and shortest <= b - a <= longest and (from_y is None or a >= from_y)]


def field(ink: np.ndarray, first: int, left_limit: int = LEFT_LIMIT, right_limit: int = RIGHT_LIMIT, narrowest: int = FIELD_MIN, share: float = SEPARATOR_SHARE, shortest: int = SEPARATOR_MIN) -> tuple[int, int] | None:
    """(lo, hi) between the widest separator on the left and the widest on the right, the leftmost of equals; None where either is missing, there is no ink, or the field is narrow. ink: by pixel column from first on."""
    if not len(ink) or not ink.max() > 0:
        return None
    gaps = [(a, b) for a, b, open_ in runs_of(ink <= ink.max() * share, np.arange(first, first + len(ink))) if open_ or b - a >= shortest]
    widest = lambda own: max(own, key=lambda g: (g[1] - g[0], -g[0]), default=None)
    left, right = widest([g for g in gaps if g[1] <= left_limit]), widest([g for g in gaps if g[0] >= right_limit])
    return (left[1], right[0]) if left and right and right[0] - left[1] >= narrowest else None


def darkness(grey: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """How much darker pixels of a window of columns are than the middle of their row."""
    window = grey[:, lo:hi]
    return np.clip(np.median(window, axis=1, keepdims=True) - window, 0, None) if window.size else window


@dataclass(frozen=True)
class Layout:
    """Where a page's field is and where its rows begin. columns: fixed ones, or None where the field is searched for in search; least_side: smaller images are no pages; from_y: bands that begin above it are left out."""

    columns: tuple[int, int] | None = None
    search: tuple[int, int] = SEARCH
    least_side: int = LEAST_SIDE
    from_y: int | None = HEADER_Y


RA = Layout()
DEC = Layout(columns=DEC_COLUMN, least_side=1, from_y=None)


def read_page(grey: np.ndarray | None, layout: Layout, engine: Engine, variants=tuple(VARIANTS)) -> tuple[str | None, tuple[int, int] | None, list[tuple[list[int], list[str]]]]:
    """(state, columns, rows) of a decoded page, grey None if it couldn't be: a page with a state has no rows; one without bands has neither."""
    if grey is None or min(grey.shape) < layout.least_side:
        return INVALID, None, []
    columns = layout.columns
    if columns is None:
        dark = darkness(grey, *layout.search)
        columns = field((dark > INK).mean(axis=0), layout.search[0])
        if columns is None:
            return UNRESOLVED, None, []
    dark = darkness(grey, *columns)
    rows = []
    for y0, y1 in bands((dark > INK).mean(axis=1) if dark.size else np.zeros(0), from_y=layout.from_y):
        part = dark[max(0, y0 - PADDING) : y1 + PADDING]
        rows.append(([y0, y1], [engine(np.where(part > v[2], 0, 255).astype(np.uint8), v) for v in variants]))
    return None, columns, rows


def transcribed(images: DataFrame, engine: Engine, layout: Layout = RA, variants=tuple(VARIANTS)) -> DataFrame:
    """PAGE's record of each image (page, height, width, channels, data), in one pass; what an engine raises is its page's failure, EXTRACTION, and the others go on. White space around reads is trimmed.

    Images are decoded once, where Spark reads them, and only records leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                page, h, w, c, data = (b.column(k)[i].as_py() for k in range(5))
                record = {"page": page, "page_state": None, "ra_column": None, "rows": [], "failure": None, "detail": None}
                try:
                    grey = None if data is None or h is None or h <= 0 else _grey(h, w, c, data)
                    state, columns, rows = read_page(grey, layout, engine, variants)
                    record |= {"page_state": state, "ra_column": columns and [int(x) for x in columns], "rows": [{"row_y": y, "raw_reads": [None if t is None else str(t) for t in reads]} for y, reads in rows]}
                except Exception as e:  # whatever an engine raises is this page's failure, not the job's
                    record |= {"failure": "EXTRACTION", "detail": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([record], _PAGE)

    read = images.select("page", "height", "width", "channels", "data").mapInArrow(run, PAGE)
    return read.withColumn("rows", F.transform("rows", lambda r: F.struct(r["row_y"].alias("row_y"), F.transform(r["raw_reads"], clean_read).alias("raw_reads"))))


def page_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep, page, page_state, ra_column, row_y, raw_reads, failure, detail): a row for each row of PAGE's records, and one whose row_y is null for a page with a state or a failure. A page without rows and without either has none."""
    whole = F.col("page_state").isNotNull() | F.col("failure").isNotNull()
    there = pages.where(whole | (F.size("rows") > 0))
    each = there.select(*keep, "page", "page_state", "ra_column", "failure", "detail", F.explode_outer(F.when(whole, F.array().cast("array<struct<row_y:array<int>,raw_reads:array<string>>>")).otherwise(F.col("rows"))).alias("_row"))
    return each.select(*keep, "page", "page_state", "ra_column", F.col("_row")["row_y"].alias("row_y"), F.col("_row")["raw_reads"].alias("raw_reads"), "failure", "detail")


def bands_of_arrays(profiles: DataFrame, page: str = "page", ink: str = "ink", share: float = ROW_SHARE, shortest: int = ROW_MIN, longest: int = ROW_MAX, from_y: int | None = None) -> DataFrame:
    """(page, start, end): segments.row_bands() of profiles that are arrays, one a row: no row for a pixel, no window and no shuffle. Nulls in a profile are no ink; null profiles have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *band) for i, own in enumerate(_arrays(b.column(1))) for band in bands(own, share, shortest, longest, from_y)]
            at = pa.array([i for i, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array([f[k] for f in found], pa.int32()) for k in (1, 2))], ["page", "start", "end"])

    kind = profiles.schema[page].dataType.simpleString()
    return profiles.select(F.col(page).alias("page"), F.col(ink).cast("array<double>").alias("ink")).mapInArrow(run, f"page {kind}, start int, end int")


def fields_of_arrays(profiles: DataFrame, page: str = "page", ink: str = "ink", first: int = 0, left_limit: int = LEFT_LIMIT, right_limit: int = RIGHT_LIMIT, narrowest: int = FIELD_MIN) -> DataFrame:
    """(page, lo, hi): segments.locate_column() of profiles that are arrays from column first on, a row for each; null where the field can't be told, as in null and empty profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [field(own, first, left_limit, right_limit, narrowest) or (None, None) for own in _arrays(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1))], ["page", "lo", "hi"])

    kind = profiles.schema[page].dataType.simpleString()
    return profiles.select(F.col(page).alias("page"), F.col(ink).cast("array<double>").alias("ink")).mapInArrow(run, f"page {kind}, lo int, hi int")


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as arrays; nulls in them are no ink, and a null list is empty."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.nan_to_num(values, nan=0.0)
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]] if column[i].is_valid else values[:0]
