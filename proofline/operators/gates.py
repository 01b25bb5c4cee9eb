"""Structural gates: an ordered list of (predicate, state, reason). The first that holds decides; the gated value is never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sexagesimal import parse_dec, parse_ra

# Versions, bounds, reasons.
DEC_VERSION, RA_VERSION = "dec_validity_gate_v1", "ra_validity_gate_v1"
ARCMINUTES, DEGREE_BAND = 60, (-35, -20)
HOUR_MAX, MINUTE_MAX, SECOND_MAX = 23, 59, 59
ADMISSIBLE, REVIEW, UNREADABLE = "STRUCTURALLY_ADMISSIBLE", "MANUAL_REVIEW_REQUIRED", "UNREADABLE"

Rule = tuple[Column, str, Column]


def gate(rules: list[Rule], otherwise: tuple[str, str]) -> Column:
    """struct(state, reason) of the first rule whose predicate is true; one that is null isn't."""
    out = F.struct(F.lit(otherwise[0]).alias("state"), F.lit(otherwise[1]).alias("reason"))
    for holds, state, reason in reversed(rules):
        out = F.when(holds, F.struct(F.lit(state).alias("state"), reason.alias("reason"))).otherwise(out)
    return out


def dec_gate(value: Column) -> Column:
    """struct(state, reason) of a declination -DD MM."""
    p = parse_dec(value)
    return gate(
        [
            (value.isNull(), UNREADABLE, F.lit("extractor produced no value")),
            (p.isNull(), REVIEW, F.lit("value does not parse as two two-digit groups")),
            (p["min"] >= ARCMINUTES, REVIEW, F.format_string("arcminute component %d is not a valid sexagesimal minute", p["min"])),
            (~(-p["deg"]).between(*DEGREE_BAND), REVIEW, F.format_string("degree component -%d lies outside the declared plausible band", p["deg"])),
        ],
        (ADMISSIBLE, "value is a possible coordinate"),
    )


def ra_gate(value: Column) -> Column:
    """struct(state, reason) of a right ascension HH MM SS."""
    p = parse_ra(value)
    return gate(
        [
            (value.isNull(), UNREADABLE, F.lit("extractor produced no value")),
            (p.isNull(), REVIEW, F.lit("value does not parse as three two-digit groups")),
            (p["h"] > HOUR_MAX, REVIEW, F.format_string("hour component %d is outside 0 to 23", p["h"])),
            (p["m"] > MINUTE_MAX, REVIEW, F.format_string("minute component %d is outside 0 to 59", p["m"])),
            (p["s"] > SECOND_MAX, REVIEW, F.format_string("second component %d is outside 0 to 59", p["s"])),
        ],
        (ADMISSIBLE, "value is a possible right ascension"),
    )


def gated(rows: DataFrame, judged: Column, version: str) -> DataFrame:
    """All columns as they are, with gate_state, gate_reason and gate_version."""
    return rows.withColumns({"gate_state": judged["state"], "gate_reason": judged["reason"], "gate_version": F.lit(version)})


def gate_dec_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    return gated(rows, dec_gate(F.col(value)), DEC_VERSION)


def gate_ra_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    return gated(rows, ra_gate(F.col(value)), RA_VERSION)
