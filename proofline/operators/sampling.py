"""Deterministic samples of ordered runs.

A run's rows are numbered chunk by chunk (`scans`): rows are ordered within a chunk of about CHUNK rows, and one row a chunk says how many stand before it, so that no run is
ordered by one task, whatever its order is made of. Ties are broken by the row's other columns in their order, so that only rows that are the same throughout are interchangeable; they are in one chunk, and a null order stands first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from .scans import CHUNK, chunks


def in_order(rows: DataFrame, order: str) -> list[Column]:
    """What rows are ordered by: a column, then all others that have an order."""
    return [F.col(order), *[F.col(f"`{c}`") for c, kind in rows.dtypes if c != order and "map<" not in kind and "variant" not in kind]]


def ranked(rows: DataFrame, run: str, order: str, chunk: int = CHUNK) -> tuple[DataFrame, str, str]:
    """rows with each one's number in its run, from 0, and the run's number of rows, in columns whose names are returned with them. Null runs are one run."""
    i, n = unused(rows, "_i", "_n")
    cut = chunks(rows, run, order, chunk)
    inside = cut.rows.withColumns({i: F.row_number().over(cut.window(*in_order(rows, order))) - 1, n: F.count(F.lit(1)).over(cut.window())})
    sizes = cut.summary(F.count(F.lit(1)).alias("_rows"))
    before, all_ = F.sum("_rows").over(cut.along().rowsBetween(Window.unboundedPreceding, -1)), F.sum("_rows").over(Window.partitionBy("_of_part"))
    met, known = cut.enter(inside, sizes.select("_of_part", "_of_chunk", F.struct(F.coalesce(before, F.lit(0)).alias("before"), all_.alias("all")).alias("_known")), "_known")
    return met.select(*cut.given(), (F.col(i) + F.coalesce(known["before"], F.lit(0))).alias(i), F.coalesce(known["all"], F.col(n)).alias(n)), i, n


def first_middle_last(rows: DataFrame, run: str, order: str) -> DataFrame:
    """With position (first, middle, last): the three rows of each run, the middle at floor((n - 1) / 2) from 0; all rows of a run of fewer than three, the first and the last."""
    r, i, n = ranked(rows, run, order)
    middle = F.floor((F.col(n) - 1) / 2)
    name = F.when(F.col(i) == 0, "first").when(F.col(i) == F.col(n) - 1, "last").when((F.col(n) >= 3) & (F.col(i) == middle), "middle")
    return r.withColumn("position", name).where("position is not null").drop(i, n)


def at_fractions(rows: DataFrame, run: str, order: str, percents: tuple[int, ...] = (5, 22, 39, 56, 73, 90)) -> DataFrame:
    """The rows at the given percents of each run's length, half rounded up; positions that fall together give one row."""
    r, i, n = ranked(rows, run, order)
    # Whole numbers: floor((percent * (n - 1) + 50) / 100).
    wanted = F.array(*[F.floor((F.lit(p) * (F.col(n) - 1) + 50) / 100) for p in percents])
    return r.where(F.array_contains(wanted, F.col(i).cast("long"))).drop(i, n)


def every_kth(rows: DataFrame, run: str, order: str, k: int = 4, start: int = 0) -> DataFrame:
    """Every kth row of each run from the one at start on, counted from 0."""
    r, i, n = ranked(rows, run, order)
    return r.where((F.col(i) >= start) & ((F.col(i) - start) % k == 0)).drop(i, n)


def low_middle_high_and_every_kth(rows: DataFrame, run: str, order: str, k: int = 4) -> DataFrame:
    """With chosen_as (low, middle, high, interval): each run's first, middle and last row, and of the others every kth from the first on."""
    r, i, n = ranked(rows, run, order)
    name = F.when(F.col(i) == 0, "low").when(F.col(i) == F.col(n) - 1, "high").when(F.col(i) == F.floor((F.col(n) - 1) / 2), "middle").when(F.col(i) % k == 0, "interval")
    return r.withColumn("chosen_as", name).where("chosen_as is not null").drop(i, n)


def outward(rows: DataFrame, at: str, anchor: Column | int) -> DataFrame:
    """With step: rows in order outward from an anchor, the earlier of two at one distance first."""
    anchor = anchor if isinstance(anchor, Column) else F.lit(anchor)
    step = F.when(F.col(at) == anchor, 0).when(F.col(at) < anchor, 2 * (anchor - F.col(at)) - 1).otherwise(2 * (F.col(at) - anchor))
    return rows.withColumn("step", step)


def seeded(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of each stratum whose hashes of seed and key are lowest, with rank from 1: the same rows on every run, whatever the partitions. Ties go to the smaller key, then by the other columns.

    The filter on the rank lets Spark drop the rest of a stratum before the shuffle.
    """
    (h,) = unused(rows, "_h")
    hashed = rows.withColumn(h, F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")))
    return hashed.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(h, *in_order(rows, key)))).where(F.col("rank") <= n).drop(h)
