"""Quality rules: counts of a text, and limits on how much of it repeats, by suffix arrays.

A suffix array over the words of a batch of texts, each text for itself, is made by prefix doubling: only suffixes that aren't told apart yet are sorted again. The longest common prefix of a suffix and the one before it
in order is compared word by word only where the words before the two differ (their sum is n log n at most); elsewhere it is one less than that of the position before. The innermost interval of common prefixes
that holds a suffix has the length of the longer of the two that it has with its neighbours: the longest maximal repeat that begins there. The union of those spans is the union of all repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cuts

#: A text is dropped if repeats of REPEAT_WORDS or more cover more than this share of its words, or the longest repeat has more words than this.
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 5, 0.4, 150
#: The base rules: least number of words, and the share of words in repeated windows of so many words.
LEAST_WORDS, WINDOW, MAX_WINDOWED = 50, 3, 0.5
SPACES, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>"
#: Characters whose suffixes are sorted at a time, at least one text.
BATCH_CHARS = 1 << 20
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long, repeats array<struct<start:long,end:long>>"


def suffix_order(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions in the order of (text, suffix to the text's end). codes and text hold a number for each word and the number of its text, in order of texts."""
    n = len(codes)
    ends = np.searchsorted(text, text, side="right")
    first = text.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    opens = np.flatnonzero(np.r_[True, np.diff(first[order]) != 0])
    rank[order] = np.repeat(opens, np.diff(np.r_[opens, n]))  # how many suffixes come before those that begin alike
    step = 1
    while True:
        # Suffixes that others begin like, in order.
        in_order = rank[order]
        alone = np.diff(np.r_[-1, in_order]) != 0
        alone &= np.r_[alone[1:], True]
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        at = order[places]
        further = np.where(at + step < ends[at], rank[np.minimum(at + step, n - 1)], -1)
        group = in_order[places]
        by = np.lexsort((further, group))
        at, further = at[by], further[by]
        order[places] = at
        new = np.r_[True, (np.diff(group) != 0) | (np.diff(further) != 0)]
        rank[at] = places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2


def _common(codes: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the common prefixes of suffixes a and b of the same texts, compared block by block."""
    length = np.zeros(len(a), np.int64)
    most = np.minimum(ends[a] - a, ends[b] - b)
    on = np.flatnonzero(most > 0)
    while len(on):
        width = int(max(8, min(1 << 14, (1 << 18) // len(on))))
        reach = np.arange(width)
        x, y = (np.minimum(p[on, None] + length[on, None] + reach, len(codes) - 1) for p in (a, b))
        same = (codes[x] == codes[y]) & (length[on, None] + reach < most[on, None])
        whole = same.all(1)
        length[on] += np.where(whole, width, np.argmin(same, axis=1))
        on = on[whole]
    return length


def longest_repeats(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run of words from there that its text has at another place as well (places may overlap)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    order = suffix_order(codes, text)
    ends = np.searchsorted(text, text, side="right")
    before = np.full(n, -1)  # the suffix before each in order, of the same text
    near = text[order[1:]] == text[order[:-1]]
    before[order[1:][near]] = order[:-1][near]
    # Where the words before two neighbours agree, their common prefix is one shorter than that of the position before.
    where = np.arange(n)
    follows = (before > 0) & (where > 0)
    p = np.maximum(before, 1)
    follows[1:] &= (text[1:] == text[:-1]) & (text[p[1:] - 1] == text[1:]) & (codes[p[1:] - 1] == codes[:-1])
    compared = np.flatnonzero(~follows)
    common = np.zeros(n, np.int64)
    has = compared[before[compared] >= 0]
    common[has] = _common(codes, ends, has, before[has])
    source = np.maximum.accumulate(np.where(follows, 0, where))
    common = np.maximum(common[source] - (where - source), 0)
    after = np.zeros(n, np.int64)
    after[before[before >= 0]] = common[before >= 0]
    return np.maximum(common, after)


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least so many words."""
    where = np.arange(len(longest))
    return np.maximum.accumulate(np.where(longest >= least, where + longest, 0)) > where if len(longest) else np.zeros(0, bool)


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def rules(texts: list[str | None], least: int = REPEAT_WORDS, window: int = WINDOW) -> list[tuple]:
    """A row of RESULT for each text: words are what ASCII white space parts; repeats are the maximal spans of words that repeats of least words or more cover."""
    texts = [t or "" for t in texts]
    found = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    codes = pd.factorize(np.array([w for own in found for w in own] + [b""], object)[:-1])[0].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    longest = longest_repeats(codes, text)
    windowed = np.bincount(text[covered(longest, window)], minlength=len(texts))
    inside = covered(longest, least)
    n_inside = np.bincount(text[inside], minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, text, longest)
    # Spans: runs of covered positions within a text.
    begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1] & (text[:-1] == text[1:])]) if len(text) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & ~np.r_[inside[1:] & (text[:-1] == text[1:]), False]) + 1 if len(text) else begins
    starts = np.cumsum(sizes) - sizes
    of = np.searchsorted(text[begins], np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        own = slice(of[i], of[i + 1])
        spans = [{"start": a, "end": b} for a, b in zip((begins[own] - starts[i]).tolist(), (ends[own] - starts[i]).tolist())]
        out.append((int(sizes[i]), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), _duplicate_lines(t), int(windowed[i]), int(n_inside[i]), int(top[i]), spans))
    return out


def rules_column(text: Column) -> Column:
    """The struct RESULT of a whole text; null and empty texts have zeros and no repeats."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def of(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, out = f.tolist(), []
            for lo, hi in cuts([len(t or "") for t in texts], BATCH_CHARS):
                out += rules(texts[lo:hi])
            yield pd.DataFrame(out, columns=names)

    return of(text)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """({id_col}, RESULT's columns, base_failed, kept): a row for each row of docs.

    base_failed: fewer than LEAST_WORDS words, or more than MAX_WINDOWED of them in windows of WINDOW words that the text has twice. kept: neither that, nor more than max_covered of the words in repeats of REPEAT_WORDS or more,
    nor a repeat of more than max_longest words. Null and empty texts have no words and fail. Repeated rows and null ids stay; other columns aren't returned.
    """
    each = docs.select(F.col(id_col), rules_column(F.col(text_col).cast("string")).alias("_r")).select(id_col, "_r.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_WINDOWED) * F.col("n_words"))
    kept = ~failed & (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest") <= max_longest)
    return each.withColumns({"base_failed": failed, "kept": kept})


def op13(docs: DataFrame) -> DataFrame:
    """The digest of quality_rules() that op13_quality_rules returns."""
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "base_failed", "kept")


_HAS_WORD, _FAILED = r"lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')", f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_WINDOWED)} * n_words)"


def _windows(size: int, name: str) -> str:
    """(r, {name}): how many words of each row lie in windows of so many words that the row has twice."""
    return f"""
{name} AS (
  SELECT r, count(DISTINCT p) AS {name} FROM (
    SELECT r, unnest(range(i, i + {size})) AS p FROM (
      SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, md5(array_to_string(w[i : i + {size - 1}], ' ')) AS g FROM (SELECT r, w, unnest(range(1, n_words - {size} + 2)) AS i FROM d WHERE n_words >= {size}))
    ) WHERE n > 1
  ) GROUP BY r
)"""


#: What repeats of k words or more cover, windows of k words that occur twice cover; the longest repeat is over a limit if a window of one word more occurs twice.
OP13_SQL = rf"""
WITH d AS (
  SELECT *, len(w)::BIGINT AS n_words FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
),{_windows(WINDOW, "windowed")},{_windows(REPEAT_WORDS, "inside")},{_windows(MAX_LONGEST + 1, "long")},
lines AS (SELECT r, list_filter(string_split(text, chr(10)), {_HAS_WORD}) AS own FROM d),
counted AS (
  SELECT doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(own) - len(list_distinct(own)))::BIGINT AS n_dup_lines, coalesce(windowed, 0)::BIGINT AS n_repeat_words, coalesce(inside, 0)::BIGINT AS n_covered, coalesce(long, 0) AS long
  FROM d JOIN lines USING (r) LEFT JOIN windowed USING (r) LEFT JOIN inside USING (r) LEFT JOIN long USING (r)
)
SELECT * EXCLUDE (long), {_FAILED} AS base_failed, NOT {_FAILED} AND n_covered <= {MAX_COVERED} * n_words AND long = 0 AS kept FROM counted
"""
