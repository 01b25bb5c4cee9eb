"""Small text and geometry functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a page's class, in the order in which they are looked for.
PAGE_KEYWORDS = [("DECLINATION", "HEADER_PAGE"), ("CHANNEL NUMBER", "DATA_PAGE"), ("JOB", "JOB_LISTING_PAGE"), ("PAGE", "JOB_LISTING_PAGE")]

# White space, the 29 characters that have Unicode's property or part lines or fields in ASCII.
WHITE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_BLANK = f"[{WHITE}]"


def clean_read(text: Column) -> Column:
    """White space of any kind trimmed, each line break inside a space."""
    return F.regexp_replace(F.regexp_replace(text, rf"\A{_BLANK}+|{_BLANK}+\z", ""), "\n", " ")


def tokens(text: Column) -> Column:
    """What stands between white space; a blank text has none."""
    return F.filter(F.split(text, rf"{_BLANK}+"), lambda t: t != "")


def page_stem(folder: Column, number: Column) -> Column:
    """folder-NNN, the number padded to three digits."""
    return F.format_string("%s-%03d", folder, number)


def source_url(base: str, folder: Column, stem: Column) -> Column:
    return F.format_string(f"{base.replace('%', '%%')}/folder.%s/%s.jpg", folder, stem)


def page_class(text: Column) -> Column:
    """The class that a page's keywords tell, UNDETERMINED without any; a null text is null."""
    out = F.lit("UNDETERMINED")
    for word, name in reversed(PAGE_KEYWORDS):
        out = F.when(text.contains(word), name).otherwise(out)
    return F.when(text.isNotNull(), out)


def utc_stamp(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of a timestamp, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def printed_date(text: Column, century: int = 19) -> Column:
    """The date of a text like 8 AUG 77 in a century that is stated, null if it is none."""
    whole = F.regexp_replace(F.initcap(text), r"([0-9]{2})\z", f"{century}$1")
    return F.try_to_timestamp(whole, F.lit("d MMM yyyy")).cast("date")


def rescaled(rect: Column, width: Column, height: Column, to_width: Column, to_height: Column, tolerance: float = 0.02) -> Column:
    """A rectangle (x0, y0, x1, y1) of an image in another size of it; null where the two sizes differ in aspect by more than the tolerance."""
    sx, sy = to_width / width, to_height / height
    scaled = F.struct(*[F.round(rect[c] * (sx if c[0] == "x" else sy)).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return F.when(F.abs(sx / sy - 1) <= tolerance, scaled)
