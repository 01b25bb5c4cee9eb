"""Sexagesimal coordinate strings as Catalyst expressions. Digits are ASCII; nothing is ever repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE

_SPACE = f"[{WHITE}]*"


def _grouped(text: Column, groups: int, prefix: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1))
    joined = F.element_at(found, 1)
    apart = (F.size(found) == groups) & F.forall(found, lambda g: F.length(g) == 2)
    together = (F.size(found) == 1) & (F.length(joined) == 2 * groups)
    pairs = [F.substring(joined, 2 * i + 1, 2) for i in range(groups)]
    return F.when(apart, F.concat(F.lit(prefix), F.array_join(found, " "))).when(together, F.concat(F.lit(prefix), F.concat_ws(" ", *pairs)))


def normalise_dec(text: Column) -> Column:
    """-DD MM from a text with two groups of two digits or one of four, else null. A sign in the text is not read: minus stands in front always."""
    return _grouped(text, 2, "-")


def normalise_ra(text: Column) -> Column:
    """HH MM SS from a text with three groups of two digits or one of six, else null."""
    return _grouped(text, 3, "")


def _parsed(value: Column, sign: str, names: list[str]) -> Column:
    pattern = rf"\A{_SPACE}{sign}" + f"[{WHITE}]+".join([r"([0-9]{2})"] * len(names)) + rf"{_SPACE}\z"
    part = lambda i: F.regexp_extract(value, pattern, i).cast("int")
    return F.when(value.rlike(pattern), F.struct(*[part(i).alias(n) for i, n in enumerate(names, 1)]))


def parse_dec(value: Column) -> Column:
    """struct(deg, min) of a whole string -DD MM, else null."""
    return _parsed(value, "-", ["deg", "min"])


def parse_ra(value: Column) -> Column:
    """struct(h, m, s) of a whole string HH MM SS, else null."""
    return _parsed(value, "", ["h", "m", "s"])


def dec_arcminutes(value: Column) -> Column:
    """Signed arcminutes of -DD MM, null if it doesn't parse."""
    p = parse_dec(value)
    return -(p["deg"] * 60 + p["min"])


def ra_seconds(value: Column) -> Column:
    """Seconds of time of HH MM SS, null if it doesn't parse."""
    p = parse_ra(value)
    return p["h"] * 3600 + p["m"] * 60 + p["s"]


def edge_distance(value: Column, low: Column | float, high: Column | float) -> Column:
    """Distance to the nearest edge of a window: positive inside, negative outside."""
    low, high = F.lit(low) if not isinstance(low, Column) else low, F.lit(high) if not isinstance(high, Column) else high
    return F.least(value - low, high - value)
