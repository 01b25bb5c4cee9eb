"""Row records: raw reads become normalised reads, a vote, a gated value and constant provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.consensus import consensus
from ..functions.names import unused
from ..functions.sexagesimal import normalise_dec, normalise_ra
from ..schemas import SOURCE_AUTHENTICITY
from .gates import DEC_VERSION, RA_VERSION, dec_gate, ra_gate


def voted_rows(reads: DataFrame, kind: str, raw: str = "raw_reads") -> DataFrame:
    """reads with normalised, extractor_state, extractor_value, gate_state, gate_reason and gate_version. kind: dec or ra. Rows whose reads are null (page-level records) have nulls in all."""
    normalise, gate, version = {"dec": (normalise_dec, dec_gate, DEC_VERSION), "ra": (normalise_ra, ra_gate, RA_VERSION)}[kind]
    vote, judged = unused(reads, "_v", "_g")
    has = F.col(raw).isNotNull()
    out = reads.withColumn("normalised", F.transform(raw, normalise)).withColumn(vote, consensus(F.col("normalised")))
    out = out.withColumns({"extractor_state": F.when(has, F.col(vote)["state"]), "extractor_value": F.when(has, F.col(vote)["value"])}).withColumn(judged, gate(F.col("extractor_value")))
    return out.withColumns({"gate_state": F.when(has, F.col(judged)["state"]), "gate_reason": F.when(has, F.col(judged)["reason"]), "gate_version": F.when(has, F.lit(version))}).drop(vote, judged)


def indexed_rows(rows: DataFrame, page: str = "page", row: str = "row_y") -> DataFrame:
    """With row_index, from 0 down each page; page-level records have none."""
    i = F.row_number().over(Window.partitionBy(page, F.col(row).isNull()).orderBy(row)) - 1
    return rows.withColumn("row_index", F.when(F.col(row).isNotNull(), i))


def with_provenance(rows: DataFrame, constants: dict[str, str | Column]) -> DataFrame:
    """rows with columns that say where they come from: transport, tool names and hashes, and that authenticity is not established."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in constants.items()}
    return rows.withColumns(given | {"source_authenticity": F.lit(SOURCE_AUTHENTICITY)})


def in_scope(rows: DataFrame, allowed: list[str], *wanted: str) -> DataFrame:
    """The wanted columns, all allowed ones by default. A column outside the allowed ones raises before anything is read."""
    outside = [c for c in wanted if c not in allowed]
    if outside:
        raise ValueError(f"outside the read scope: {', '.join(outside)}")
    return rows.select(*(wanted or allowed))
