"""Consensus over repeated reads of one value, within the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def consensus(reads: Column, minimum: int = 2) -> Column:
    """struct(state, value, votes) of an array of reads: nulls and empty reads don't vote.

    No vote: UNREADABLE. The most frequent read, the earlier of equals, is TRANSCRIBED if it has the minimum of votes; else MANUAL_REVIEW_REQUIRED without
    a value. A null array is no vote.
    """
    good = F.filter(F.coalesce(reads, F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != ""))
    ranked = F.transform(F.array_distinct(good), lambda v, i: F.struct(F.size(F.filter(good, lambda r: r == v)).alias("votes"), (-i).alias("order"), v.alias("value")))
    top = F.array_max(ranked)
    agreed = top["votes"] >= minimum
    state = F.when(top.isNull(), "UNREADABLE").when(agreed, "TRANSCRIBED").otherwise("MANUAL_REVIEW_REQUIRED")
    return F.struct(state.alias("state"), F.when(agreed, top["value"]).alias("value"), F.coalesce(top["votes"], F.lit(0)).alias("votes"))
