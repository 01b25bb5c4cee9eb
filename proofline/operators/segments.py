"""Runs of pixels along a profile: text bands and low-ink separators, and the column between two of them.

A profile belongs to one page and is at most as long as the page is high or wide, so that a window by page stays small. Its places are distinct; those that are null or absent belong to no run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused

# Thresholds of bands and separators, in shares and pixels.
ROW_SHARE, ROW_MIN, ROW_MAX, HEADER_Y = 0.08, 6, 40, 260
SEPARATOR_SHARE, SEPARATOR_MIN = 0.06, 8
LEFT_LIMIT, RIGHT_LIMIT, FIELD_MIN = 1110, 1150, 60


def _runs(profile: DataFrame, page: str, pos: str, on: Column) -> DataFrame:
    """(page, start, end, at_end): maximal runs of consecutive places where on holds, half open; a place that is absent ends a run. at_end: the run reaches the page's last place."""
    on_, last, place, run = unused(profile, "_on", "_last", "_place", "_run")
    by_page = Window.partitionBy(page)
    marked = profile.select(page, pos, (F.coalesce(on, F.lit(False)) & F.col(pos).isNotNull()).alias(on_), F.max(pos).over(by_page).alias(last)).where(on_)
    # Among the places where it holds, those of one run are as far from their numbers.
    runs = marked.withColumn(run, F.col(pos) - F.row_number().over(by_page.orderBy(pos))).groupBy(page, run).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.first(last).alias(place))
    return runs.select(page, "start", "end", (F.col("end") > F.col(place)).alias("at_end"))


def row_bands(profile: DataFrame, page: str = "page", pos: str = "y", value: str = "ink", share: float = ROW_SHARE, shortest: int = ROW_MIN, longest: int = ROW_MAX, from_y: int | None = None) -> DataFrame:
    """(page, start, end): bands of ink above share, of a height within bounds. A band still open at the last pixel is none. from_y leaves out bands that begin above it (a printed header)."""
    runs = _runs(profile, page, pos, F.col(value) > share).where(~F.col("at_end") & (F.col("end") - F.col("start")).between(shortest, longest))
    return (runs if from_y is None else runs.where(F.col("start") >= from_y)).select(page, "start", "end")


def separators(profile: DataFrame, page: str = "page", pos: str = "x", value: str = "ink", share: float = SEPARATOR_SHARE, shortest: int = SEPARATOR_MIN) -> DataFrame:
    """(page, start, end): runs of at most share of the page's highest ink, shortest or longer. A run open at the last pixel is one whatever its length."""
    (top,) = unused(profile, "_top")
    scaled = profile.withColumn(top, F.max(value).over(Window.partitionBy(page)))
    runs = _runs(scaled, page, pos, F.col(value) <= F.col(top) * share)
    return runs.where(F.col("at_end") | (F.col("end") - F.col("start") >= shortest)).select(page, "start", "end")


def locate_column(profile: DataFrame, page: str = "page", pos: str = "x", value: str = "ink", left_limit: int = LEFT_LIMIT, right_limit: int = RIGHT_LIMIT, narrowest: int = FIELD_MIN) -> DataFrame:
    """(page, lo, hi) for every page: from the end of the widest separator on the left to the start of the widest on the right, the leftmost of equals; null where either is missing, the page has no ink, or the field is narrow."""
    found = separators(profile, page, pos, value)
    width = lambda c: F.struct((F.col("end") - F.col("start")).alias("width"), (-F.col("start")).alias("first"), F.col(c).alias("at"))
    best = found.groupBy(page).agg(F.max(F.when(F.col("end") <= left_limit, width("end"))).alias("l"), F.max(F.when(F.col("start") >= right_limit, width("start"))).alias("r"))
    pages = profile.groupBy(page).agg(F.max(value).alias("top"))
    lo, hi = F.col("l.at"), F.col("r.at")
    good = (F.col("top") > 0) & (hi - lo >= narrowest)
    return pages.join(best, page, "left").select(page, F.when(good, lo).alias("lo"), F.when(good, hi).alias("hi"))


def numbered_rows(bands: DataFrame, page: str = "page", start: str = "start") -> DataFrame:
    """With row_index, counted from 0 down each page."""
    return bands.withColumn("row_index", F.row_number().over(Window.partitionBy(page).orderBy(start)) - 1)
