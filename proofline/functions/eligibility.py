"""Windows and eligibility decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The declination window in J2000 degrees, the frequency window in kHz, the dates (the end is inclusive).
DEC_WINDOW = (-27.283333, -26.616667)
FREQUENCY_WINDOW_KHZ = (1420351, 1420731)
DATE_WINDOW = ("1977-08-08", "1977-08-22")


def in_dec_window(dec_deg: Column) -> Column:
    return dec_deg.between(*DEC_WINDOW)


def in_frequency_window(khz: Column) -> Column:
    return khz.between(*FREQUENCY_WINDOW_KHZ)


def in_date_window(ts: Column, first: str = DATE_WINDOW[0], last: str = DATE_WINDOW[1]) -> Column:
    """From the first day's start to the last day's end; half open, so that no moment of the last day is lost."""
    return (ts >= F.lit(first).cast("timestamp")) & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


def eligibility(in_dates: Column, in_declinations: Column) -> Column:
    """The dates decide first; an unknown declination is a state of its own and excluded."""
    return F.when(~F.coalesce(in_dates, F.lit(False)), "INELIGIBLE_BY_DATE").when(in_declinations.isNull(), "DECLINATION_UNKNOWN").when(in_declinations, "D2_SPATIAL_ELIGIBLE").otherwise("D2_SPATIAL_INELIGIBLE")
