"""Names for columns that a table doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns of df that it has none of, made from those given."""
    taken = {c.lower() for c in df.columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if (n + "_" * k).lower() not in taken) for n in names]
