"""B1950 to J2000 (FK4 to FK5) as Catalyst trigonometry, without proper motion.

A position is a pair: a declination is never transformed without its right ascension. This is an implementation of its own from the published
constants, not a certified ephemeris tool.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# E-terms of aberration and the rotation from B1950 to J2000 for positions of epoch 1950, as published.
E_TERMS = (-1.62557e-6, -0.31919e-6, -0.13843e-6)
MATRIX = (
    (0.9999256794956877, -0.0111814832204662, -0.0048590038153592),
    (0.0111814832391717, 0.9999374848933135, -0.0000271625947142),
    (0.0048590037723143, -0.0000271702937440, 0.9999881946023742),
)


def _let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """then of a struct of values, each of which is computed once however often then names it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), then), F.lit(0))


def b1950_to_j2000(ra_deg: Column, dec_deg: Column) -> Column:
    """struct(ra_deg, dec_deg) in J2000; null if either is null."""

    def rotated(v: Column) -> Column:
        dot = v["x"] * E_TERMS[0] + v["y"] * E_TERMS[1] + v["z"] * E_TERMS[2]
        return _let({"x": v["x"], "y": v["y"], "z": v["z"], "dot": dot}, lambda t: _let({n: t[n] - F.lit(E_TERMS[i]) + t[n] * t["dot"] for i, n in enumerate("xyz")}, turned))

    def turned(u: Column) -> Column:
        return _let({n: u["x"] * row[0] + u["y"] * row[1] + u["z"] * row[2] for n, row in zip("xyz", MATRIX)}, angles)

    def angles(w: Column) -> Column:
        found = {"ra": F.degrees(F.atan2(w["y"], w["x"])), "dec": F.degrees(F.atan2(w["z"], F.hypot(w["x"], w["y"])))}
        return _let(found, lambda x: F.struct(F.when(x["ra"] < 0, x["ra"] + 360.0).otherwise(x["ra"]).alias("ra_deg"), x["dec"].alias("dec_deg")))

    a, d = F.radians(ra_deg), F.radians(dec_deg)
    trig = {"ca": F.cos(a), "sa": F.sin(a), "cd": F.cos(d), "sd": F.sin(d)}
    out = _let(trig, lambda t: _let({"x": t["ca"] * t["cd"], "y": t["sa"] * t["cd"], "z": t["sd"]}, rotated))
    return F.when(ra_deg.isNotNull() & dec_deg.isNotNull(), out)
