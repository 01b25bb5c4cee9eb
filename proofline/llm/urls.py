"""URL filters: rules by host and path, and for urls that no rule fits a ratio of two character language models.

The models are smoothed variable-order Markov models of the urls that rules allow and of those that they block. The chance of a character
after a context of k characters is mixed with that after the shorter one, as if the latter had been seen PRIOR times. A place's chances depend on
the six bytes that end there, which are one number: distinct numbers are counted as rows of a table, all of them exactly, shorter contexts
are its sums, and each length's chances come from a join with those of the next shorter one, in which no key meets more than 256 rows. Numbers that make up a large share
of all places are few and broadcast; places of the others are joined with the table. A
url's log-likelihood difference, by its length, goes through a logistic curve fitted on a fifth of the urls (by checksum) that
the counts leave out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cuts, settle
from .toxicity import logistic

#: Contexts have up to ORDER characters (bytes of UTF-8).
ORDER, PRIOR = 5, 2.0
#: Grams that make up one in HOT of all places or more are broadcast, 16 bytes each: HOT at most.
HOT = 1 << 17
#: Differences are summed as whole numbers of 1 / UNIT, so that no order of adding shows; batches are cut at so many characters.
UNIT, CHARACTERS = float(1 << 32), 1 << 19
#: Calibration counts urls by class in so many steps of the difference between -RANGE and RANGE.
STEPS, RANGE = 800, 8.0
_START, _END = 2, 3

# Verdict, host and path of each rule.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.get(F.split(F.coalesce(url, F.lit("")), "://", 2), 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    rest = F.get(F.split(F.coalesce(url, F.lit("")), "://", 2), 1)
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Of rules as long as each other the one with the longer host wins, then the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _grams(urls: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For a batch of urls as one run of characters: for each order the characters up to each place as one number; the places that are predicted; the url of each."""
    pad = bytes([_START] * (ORDER + 1))
    run = np.frombuffer(b"".join(pad + u + bytes([_END]) for u in urls), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(u) + 1 for u in urls), np.int64, len(urls))
    url = np.repeat(np.arange(len(urls)), sizes)
    at = np.arange(len(url)) + (ORDER + 1) * (url + 1)
    grams, total = [], np.zeros(len(run), np.int64)
    for k in range(ORDER + 1):
        total[k:] |= run[: len(run) - k] << 8 * k
        grams.append(total.copy())
    return grams, at, url


def _starts(at: np.ndarray, url: np.ndarray) -> np.ndarray:
    """The place before each url's first character, the context of it."""
    return at[np.flatnonzero(np.diff(url, prepend=-1))] - 1


def count_grams(urls: list[bytes]) -> list[pd.Series]:
    """Counts by gram for each order, of the characters and of each url's start, which is the context of its first one."""
    if not urls:
        return [pd.Series(dtype="int64") for _ in range(ORDER + 1)]
    grams, at, url = _grams(urls)
    places = np.concatenate([at, _starts(at, url)])
    return [pd.Series(g[places]).value_counts() for g in grams]


@dataclass
class UrlModel:
    """Counts of allowed and blocked urls on one machine: what the tables of filter_urls() come to, for tests; and the curve that makes a difference a chance."""

    counts: list[list[pd.Series]] = field(default_factory=lambda: [count_grams([]), count_grams([])])
    slope: float = 0.0
    bias: float = 0.0

    def difference(self, urls: list[bytes]) -> np.ndarray:
        """ln P(url | allowed) - ln P(url | blocked), by the number of its characters and its end."""
        if not urls:
            return np.zeros(0)
        grams, at, url = _grams(urls)
        logs = []
        for table in self.counts:
            p, seen = np.full(len(at), 1 / 257), np.full(len(at), float(table[0].sum()))
            for k in range(ORDER + 1):
                p = (table[k].reindex(grams[k][at], fill_value=0).to_numpy() + PRIOR * p) / (seen + PRIOR)
                seen = table[k].reindex(grams[k][at - 1], fill_value=0).to_numpy().astype(float)
            logs.append(np.log(p))
        sums = np.bincount(url, logs[0] - logs[1], minlength=len(urls))
        return sums / np.bincount(url, minlength=len(urls))

    def chance(self, difference: Column) -> Column:
        z = F.lit(self.slope) * difference + F.lit(self.bias)
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def gram_table(rows: DataFrame) -> DataFrame:
    """(w, a, b, m): for each gram of ORDER + 1 characters of the urls in rows (url, by_rule) how often urls that the counts learn from hold it, allowed and blocked, and how many places of all urls."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            urls = [u.encode() for u in f["url"]]
            learned = np.fromiter((zlib.crc32(u) % 5 > 0 for u in urls), bool, len(urls))
            of = [learned & (f["by_rule"] == word).to_numpy(bool) for word in ("allow", "block")]
            for lo, hi in cuts([len(u) + 1 for u in urls], CHARACTERS):
                grams, at, url = _grams(urls[lo:hi])
                start = _starts(at, url)
                w, inverse = np.unique(grams[ORDER][np.concatenate([at, start])], return_inverse=True)
                own = np.concatenate([url, np.arange(hi - lo)])
                n = [np.bincount(inverse, o[lo:hi][own], len(w)).astype(np.int64) for o in of]
                yield pd.DataFrame({"w": w, "a": n[0], "b": n[1], "m": np.bincount(inverse[: len(at)], minlength=len(w))})

    return rows.select("url", "by_rule").mapInPandas(count, "w long, a long, b long, m long").groupBy("w").agg(*[F.sum(c).alias(c) for c in "abm"])


def log_ratios(grams: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(w, m, l): for each gram of gram_table() the log-ratio of its last character's chances after the others, in 1 / UNIT."""
    by_order = [grams]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("w").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        by_order.insert(0, settle(by_order[0].groupBy(shorter.alias("w")).agg(*[F.sum(c).alias(c) for c in "abm"])))
    mixed = lambda n, p, seen: (n + PRIOR * p) / (seen + PRIOR)
    chances = by_order[0].select("w", "m", *[mixed(F.col(c), F.lit(1 / 257), F.lit(float(t))).alias(f"p{c}") for c, t in zip("ab", totals)])
    for k in range(1, ORDER + 1):
        before = chances.select(F.col("w").alias("_shorter"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"))
        context = by_order[k - 1].select(F.col("w").alias("_context"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        met = by_order[k].join(before, F.col("w").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("_shorter")).join(context, F.shiftright("w", 8) == F.col("_context"), "left")
        chances = met.select("w", "m", *[mixed(F.col(c), F.col(f"_p{c}"), F.coalesce(f"_{c}", F.lit(0))).alias(f"p{c}") for c in "ab"])
    return chances.select("w", "m", F.round((F.ln("pa") - F.ln("pb")) * UNIT).cast("long").alias("l"))


def differences(rows: DataFrame, ratios: DataFrame, hot: int = HOT) -> DataFrame:
    """rows (row, url, ..) with d, ln P(url | allowed) - ln P(url | blocked) by the number of characters and the end; row is a number of its own for each row."""
    spark = rows.sparkSession
    places = ratios.agg(F.sum("m")).first()[0] or 0
    common = F.col("m") * hot >= places
    known = ratios.where(common).select("w", "l").toPandas().sort_values("w")
    sent = spark.sparkContext.broadcast((known["w"].to_numpy(np.int64), known["l"].to_numpy(np.int64)))

    def found(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each place's gram and url, its ratio, and whether it is a common one."""
        w, l = sent.value
        grams, at, url = _grams(urls)
        g = grams[ORDER][at]
        if not len(w):
            return g, url, np.zeros(len(g), np.int64), np.zeros(len(g), bool)
        i = np.minimum(np.searchsorted(w, g), len(w) - 1)
        return g, url, l[i], w[i] == g

    @F.pandas_udf("long")
    def common_sum(urls: pd.Series) -> pd.Series:
        coded, out = [u.encode() for u in urls], np.zeros(len(urls), np.int64)
        for lo, hi in cuts([len(u) + 1 for u in coded], CHARACTERS):
            _, url, l, there = found(coded[lo:hi])
            np.add.at(out, lo + url[there], l[there])
        return pd.Series(out)

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            coded, row = [u.encode() for u in f["url"]], f["row"].to_numpy(np.int64)
            for lo, hi in cuts([len(u) + 1 for u in coded], CHARACTERS):
                g, url, _, there = found(coded[lo:hi])
                yield pd.DataFrame({"row": row[lo + url[~there]], "w": g[~there]})

    rare = rows.select("row", "url").mapInPandas(others, "row long, w long").join(ratios.where(~common).select("w", "l"), "w")
    rare = rare.groupBy(F.col("row").alias("_row")).agg(F.sum("l").alias("_rare"))
    met = rows.withColumn("_common", common_sum("url")).join(rare, F.col("row") == F.col("_row"), "left")
    d = (F.col("_common") + F.coalesce("_rare", F.lit(0))) / F.lit(UNIT) / (F.octet_length("url") + 1)
    return met.withColumn("d", d).drop("_common", "_row", "_rare")


def calibrate(scored: DataFrame) -> UrlModel:
    """The curve over the urls that the counts leave out, from rows (url, by_rule, d)."""
    model = UrlModel()
    step = F.least(F.greatest(F.floor((F.col("d") + RANGE) * (STEPS / (2 * RANGE))), F.lit(0)), F.lit(STEPS - 1))
    left_out = scored.where(F.col("by_rule").isNotNull() & (F.crc32(F.col("url").cast("binary")) % 5 == 0))
    found = left_out.groupBy((F.col("by_rule") == "block").cast("int").alias("c"), step.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["c", "b"])
    x = (found["b"].to_numpy(float) + 0.5) * (2 * RANGE / STEPS) - RANGE
    y = 1.0 - found["c"].to_numpy(float)
    n = found["n"].to_numpy(float)
    # Either class weighs one half: what rules cover says nothing of the shares elsewhere.
    weight = n.copy()
    for c in (0.0, 1.0):
        if n[y == c].sum():
            weight[y == c] *= n.sum() / (2 * n[y == c].sum())
    if len(x) and 0 < y.sum() < len(y):
        model.slope, model.bias = map(float, logistic(x, y, weight))
    else:
        model.slope = 1.0
    return model


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """({id_col}, host, path, rule, verdict, score): a row for each row of pages; score is the models' chance that the url is allowed, verdict the rule's, else allow where score is one half or more.

    A null url, and one without ://, has an empty host and path, which no rule fits; the models judge what there is of it. Repeated rows and null ids stay; other
    columns aren't returned. Without urls that rules fit every score is one half.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col).cast("string").alias("id"), ascii_lower(F.coalesce(F.col(url_col), F.lit(""))).alias("url"), host.alias("host"), path.alias("path"))
    ruled = settle(parts.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.monotonically_increasing_id().alias("row")))
    grams = settle(gram_table(ruled))
    totals = tuple(n or 0 for n in grams.agg(F.sum("a"), F.sum("b")).first())
    if all(totals):
        scored = settle(differences(ruled, settle(log_ratios(grams, totals))))
        model = calibrate(scored)
    else:
        # Urls of one class only, or none: no place tells anything.
        scored = ruled.withColumn("d", F.lit(0.0))
        model = UrlModel(bias=float(np.sign(totals[0]) - np.sign(totals[1])) * 30)

    kind = pages.schema[id_col].dataType.simpleString()
    scored = scored.withColumn("score", model.chance(F.col("d")))
    judged = F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select(F.col("id").cast(kind).alias(id_col), "host", "path", "rule", judged.alias("verdict"), "score")


def op4(pages: DataFrame) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return filter_urls(pages)
