"""Set comparisons: presence, differences, equality, missing ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
CHUNK = 4096


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b) for every key of either side."""
    marked = a.select(key, F.lit(True).alias("_a")).distinct().unionByName(b.select(key, F.lit(False).alias("_a")).distinct())
    return marked.groupBy(key).agg(F.bool_or("_a").alias("in_a"), F.bool_or(~F.col("_a")).alias("in_b"))


def equal_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: only_a, only_b (numbers of keys) and equal."""
    p = presence(a, b, key)
    only_a, only_b = F.count_if(F.col("in_a") & ~F.col("in_b")), F.count_if(F.col("in_b") & ~F.col("in_a"))
    return p.agg(only_a.alias("only_a"), only_b.alias("only_b"), ((only_a == 0) & (only_b == 0)).alias("equal"))


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same members, whatever their order and repeats."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def same_order(a: Column, b: Column) -> Column:
    """Whether two arrays are the same lists, member by member, null with null; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))


def _bounds(present: DataFrame, number: str, first: int | None, last: int | None) -> tuple[int, int]:
    """first and last where given, else the least and the greatest number that is there; an empty range without any."""
    if first is None or last is None:
        n = F.col(number).cast("long")
        least, greatest = present.agg(F.min(n), F.max(n)).first()
        first, last = (first, last) if least is None else (least if first is None else first, greatest if last is None else last)
    return (first, last) if first is not None and last is not None else (1, 0)


def missing_numbers(present: DataFrame, number: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(number) of first..last that are absent, by default between the least and the greatest that are there; none if last is before first."""
    first, last = _bounds(present, number, first, last)
    return present.sparkSession.range(first, max(first, last + 1)).select(F.col("id").alias(number)).join(present.select(F.col(number).cast("long").alias(number)).distinct(), number, "left_anti")


def _following(numbers: DataFrame, low: int, high: int, width: int, chunk: int) -> DataFrame:
    """(n, next) of distinct numbers n between low and high, next null for the greatest. Blocks of width numbers are ordered by themselves; the first number of the next block that has any comes from the
    blocks' first numbers, which are taken the same way in blocks chunk times as wide: no task orders more than chunk rows of a block."""
    block = F.expr(f"(n - {low}L) div {width}L")
    inside = numbers.select("n", block.alias("_block")).withColumn("next", F.lead("n").over(Window.partitionBy("_block").orderBy("n")))
    if high - low < width:
        return inside.select("n", "next")
    firsts = numbers.groupBy(block.alias("_block")).agg(F.min("n").alias("n")).select("n")
    after = _following(firsts, low, high, width * chunk, chunk).select(block.alias("_of"), F.col("next").alias("_then"))
    return inside.join(after, F.col("_block") == F.col("_of")).select("n", F.coalesce("next", "_then").alias("next"))


def missing_ranges(present: DataFrame, number: str, first: int | None = None, last: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(first, last, n) of maximal ranges that are absent between first and last, by default the least and the greatest that are there, from the gap after each number that is there."""
    first, last = _bounds(present, number, first, last)
    ends = present.sparkSession.createDataFrame([(first - 1,), (last + 1,)], "n long")
    seen = present.select(F.col(number).cast("long").alias("n")).where(F.col("n").between(first, last)).unionByName(ends).distinct()
    gaps = _following(seen, first - 1, last + 1, chunk, chunk).where("next > n + 1")
    return gaps.select((F.col("n") + 1).alias("first"), (F.col("next") - 1).alias("last"), (F.col("next") - F.col("n") - 1).alias("n"))


def stem_matches(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """(stem, in_a, in_b): two listings by the part of a name before its last dot."""
    stem = lambda df: df.select(F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem"))
    return presence(stem(a), stem(b), "stem")
