"""Forward fill and run segmentation along ordered sequences, and joins of places with ranges.

A sequence is cut into chunks of about equal numbers of rows (`scans`). Each chunk is scanned by itself, one row a chunk carries what enters it, and the two are joined: a
sequence of any length, sparse or ordered by text, is spread over tasks, and what one task orders is a chunk or the chunks' summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from .scans import CHUNK, chunks


def forward_fill(rows: DataFrame, part: str, order: str, marker: Column, value: str, chunk: int = CHUNK) -> DataFrame:
    """With filled, origin (READ_DIRECTLY on a marked row, DERIVED below one, else null) and source: the value and place of the nearest marked row at or before each row of its part.

    order is of any type that can be compared, without ties within a part; of marked rows that tie the one of greatest value counts. A row before the first marked one has no value, nor has one whose order is null.
    Null parts are one part, and repeated rows stay.
    """
    mark, own = unused(rows, "_mark", "_own")
    cut = chunks(rows.withColumn(mark, F.coalesce(marker, F.lit(False)) & F.col(order).isNotNull()), part, order, chunk)
    seen = F.when(F.col(mark), F.struct(F.col(order).alias("at"), F.col(value).alias("value")))
    # All rows of one order see the same: those that tie stand in one range.
    inside = cut.rows.withColumn(own, F.max(seen).over(cut.window(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = cut.summary(F.max(seen).alias("_last"))
    enters = ends.select("_of_part", "_of_chunk", F.last("_last", ignorenulls=True).over(cut.along().rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    met, before = cut.enter(inside, enters, "_before")
    found = F.when(F.col(order).isNotNull(), F.coalesce(F.col(own), before))
    origin = F.when(F.col(mark), "READ_DIRECTLY").when(found.isNotNull(), "DERIVED")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], found["value"].alias("filled"), origin.alias("origin"), found["at"].alias("source"))


def run_segments(rows: DataFrame, part: str, order: str, marker: Column, chunk: int = CHUNK) -> DataFrame:
    """With run, the number of marked rows at or before each row of its part: 0 before the first. Rows that tie are in one run; a row whose order is null has none."""
    mark, own = unused(rows, "_mark", "_own")
    cut = chunks(rows.withColumn(mark, F.coalesce(marker & F.col(order).isNotNull(), F.lit(False)).cast("long")), part, order, chunk)
    inside = cut.rows.withColumn(own, F.sum(mark).over(cut.window(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = cut.summary(F.sum(mark).alias("_n"))
    enters = ends.select("_of_part", "_of_chunk", F.sum("_n").over(cut.along().rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    met, before = cut.enter(inside, enters, "_before")
    run = F.when(F.col(order).isNotNull(), F.col(own) + F.coalesce(before, F.lit(0)))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], run.alias("run"))


def run_spans(segments: DataFrame, part: str, order: str) -> DataFrame:
    """(part, run, first, last, n): where each run begins and ends; what stands before the first marked row is no run."""
    return segments.where("run > 0").groupBy(part, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def aligned_blocks(first: Column, last: Column, levels: int) -> Column:
    """The aligned blocks, of 2**level places from number * 2**level on, that make up the places from first to last (whole numbers): an array of (level, number), two for each level at most. Nulls and a range that ends before it begins have none."""
    low = lambda k: -F.call_function("shiftright", -first, k)
    high = lambda k: F.call_function("shiftright", last + 1, k)
    block = lambda k, n: F.struct(k.alias("level"), n.alias("number"))

    def of(k: Column) -> Column:
        # What is left at a level lies from low to before high, in blocks of its size; an odd end is a block of its own, whose pair is not whole.
        l, h = low(k), high(k)
        return F.array(F.when((l < h) & (l % 2 != 0), block(k, l)), F.when((l < h) & (h % 2 != 0), block(k, h - 1)))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))
    return F.when(last >= first, F.filter(every, lambda b: b.isNotNull()))


#: Places of ranges lie between -2**LEVELS and 2**LEVELS.
LEVELS = 61


def range_join(places: DataFrame, ranges: DataFrame, key: str, at: str, first: str = "first", last: str = "last") -> DataFrame:
    """Each place with the ranges of its key that hold it, both ends included. Places and ends are numbers between -2**LEVELS and 2**LEVELS.

    Null keys and places meet nothing, a range that ends before it begins holds nothing, repeated rows of either side count each. The two sides' columns other than the key are to have different names.
    A range of any length is cut into aligned blocks, twice the logarithm of its length at most, and a place looks up the one block of each size that holds it. Which sizes there are is looked up at once (LEVELS of them at most).
    No range is met twice, as its blocks don't overlap, and no place meets a range that doesn't hold its block.
    """
    taken = {c.lower() for c in ranges.columns}
    blocks = next(n for n in unused(places, *("_blocks" + "_" * k for k in range(len(taken) + 1))) if n.lower() not in taken)
    floor = lambda c: F.floor(F.col(c)).cast("long")
    cut = ranges.where(F.col(last) >= F.col(first)).withColumn(blocks, F.explode(aligned_blocks(floor(first), floor(last), LEVELS)))
    levels = sorted(r[0] for r in cut.select(f"{blocks}.level").distinct().collect())
    up = F.array(*[F.struct(F.lit(k).alias("level"), F.call_function("shiftright", floor(at), F.lit(k)).alias("number")) for k in levels]).cast("array<struct<level:int,number:bigint>>")
    met = places.where(F.col(at).isNotNull()).withColumn(blocks, F.explode(up)).join(cut, [key, blocks])
    return met.where(F.col(at).between(F.col(first), F.col(last))).drop(blocks)
