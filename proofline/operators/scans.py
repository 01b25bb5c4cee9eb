"""Ordered parts cut into chunks of about equal numbers of rows, so that what runs along a part is a scan of each chunk and one of a row a chunk.

Where parts are cut is told by a sample of their orders, as for a sort by ranges: a part gets as many cuts as it has of the rows, and one that is smaller than a chunk mostly none. Cuts are values,
so that the same row is in the same chunk however often the rows are read and wherever Spark moves them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.names import unused

#: Rows of a chunk, about, unless more than MOST_CHUNKS were needed. Each cut is told by SAMPLED orders; what the driver gets is MOST_CHUNKS * SAMPLED orders at most, some hundred thousand.
CHUNK, MOST_CHUNKS, SAMPLED = 1 << 20, 8192, 30


@dataclass(frozen=True)
class Chunks:
    """rows with the number of each one's chunk in its part, and whether its part was cut at all, in columns of the names at and many."""

    rows: DataFrame
    part: str
    at: str
    many: str
    columns: tuple[str, ...]

    def window(self, *order) -> WindowSpec:
        """Within a chunk; parts that aren't cut are one."""
        w = Window.partitionBy(self.part, self.at)
        return w.orderBy(*order) if order else w

    def summary(self, *aggregates: Column) -> DataFrame:
        """(_of_part, _of_chunk, aggregates): a row for each chunk of the parts that were cut, no more than there are cuts and parts of them."""
        return self.rows.where(F.col(self.many)).groupBy(F.col(self.part).alias("_of_part"), F.col(self.at).alias("_of_chunk")).agg(*aggregates)

    def along(self) -> WindowSpec:
        """Over summary()'s rows, in order."""
        return Window.partitionBy("_of_part").orderBy("_of_chunk")

    def enter(self, inside: DataFrame, summary: DataFrame, name: str) -> tuple[DataFrame, Column]:
        """Rows with what their chunk's row of summary() has under a name, and the column that holds it: null in parts that weren't cut. The summary is broadcast, as its rows are bounded by MOST_CHUNKS."""
        part, chunk, got = unused(inside, "_of_part", "_of_chunk", name)
        side = summary.select(F.col("_of_part").alias(part), F.col("_of_chunk").alias(chunk), F.col(name).alias(got))
        return inside.join(F.broadcast(side), F.col(self.part).eqNullSafe(F.col(part)) & (F.col(self.at) == F.col(chunk)), "left"), F.col(got)

    def given(self) -> list[Column]:
        """The columns that the rows had."""
        return [F.col(f"`{c}`") for c in self.columns]


def chunks(rows: DataFrame, part: str, order: str, chunk: int = CHUNK) -> Chunks:
    """Cuts each part into chunks along an order of any type that can be compared. Null orders stand in a part's first chunk; rows that tie are in one chunk, however many they are. Null parts are one part.

    Rows are counted, and if they are more than a chunk, sampled, when this is called.
    """
    at, many, splits, of = unused(rows, "_chunk", "_many", "_splits", "_split_part")
    keys = rows.select(F.col(part).alias("p"), F.col(order).alias("o"))
    total = keys.count()
    wanted = min(-(-total // chunk), MOST_CHUNKS)
    if wanted <= 1:
        return Chunks(rows.withColumns({at: F.lit(0), many: F.lit(False)}), part, at, many, tuple(rows.columns))
    sampled = keys.where("o is not null").sample(min(1.0, wanted * SAMPLED / total), 7).orderBy("p", "o").collect()
    every = max(1, len(sampled) // wanted)
    by_part: dict = {}
    for p, o in sampled[every - 1 :: every]:
        by_part.setdefault(p, []).append(o)
    kinds = rows.schema
    told = StructType([StructField(of, kinds[part].dataType), StructField(splits, ArrayType(kinds[order].dataType))])
    known = rows.sparkSession.createDataFrame([(p, sorted(set(own))) if all(x == x for x in own) else (p, own) for p, own in by_part.items()], told)
    met = rows.join(F.broadcast(known), rows[part].eqNullSafe(known[of]), "left")
    number = F.coalesce(F.size(F.filter(F.col(splits), lambda s: s < F.col(order))), F.lit(0))
    return Chunks(met.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col(splits).isNull(), 0).otherwise(number).alias(at), F.col(splits).isNotNull().alias(many)), part, at, many, tuple(rows.columns))
