"""Fill-in-middle: texts cut in three and put together anew behind sentinels, as ropes.

A rope is a tree of leaves, pieces of the text; each node has the numbers of units and of code points below it. It is split at a rank of units along one path from the root, and two ropes are concatenated
under new nodes along one edge, so that what is rearranged are subtrees and not characters. The inverse splits the rope of an output at its sentinels.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix, suffix and middle begin with these. A text that has one of them stays plain.
SENTINELS = ("<P>", "<S>", "<M>")
#: In 100 texts so many aren't plain, and in 100 of those so many have the suffix first.
CUT_OF_100, SUFFIX_FIRST_OF_100 = 90, 20
SALT = "1:"
#: Code points of a leaf.
LEAF = 2048


class Rope:
    """A leaf (text, starts of its units, or None where units are code points), or a node over two ropes."""

    __slots__ = ("chars", "height", "left", "right", "starts", "text", "units")

    def __init__(self, text: str = "", starts: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.starts, self.left, self.right = text, starts, left, right
        if left is None:
            self.height, self.chars, self.units = 0, len(text), len(text) if starts is None else len(starts)
        else:
            self.height, self.chars, self.units = 1 + max(left.height, right.height), left.chars + right.chars, left.units + right.units

    @classmethod
    def of(cls, text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
        """The rope of a text. A unit reaches from the start of a match of the pattern to that of the next; text before the first match belongs to the first unit, and a text without a match is one unit, if not empty."""
        if unit is None:
            leaves = [cls(text[a : a + leaf]) for a in range(0, len(text), leaf)]
        else:
            starts = [m.start() for m in unit.finditer(text) if m.start() < len(text)]
            if text:
                starts = [0, *starts[1:]]
            leaves, lo = [], 0
            while lo < len(starts):
                hi = max(lo + 1, bisect_left(starts, starts[lo] + leaf))
                begin, end = starts[lo], starts[hi] if hi < len(starts) else len(text)
                leaves.append(cls(text[begin:end], [s - begin for s in starts[lo:hi]]))
                lo = hi
        while len(leaves) > 1:
            leaves = [a + b for a, b in zip(leaves[::2], leaves[1::2])] + leaves[len(leaves) & ~1 :]
        return leaves[0] if leaves else cls()

    def leaves(self) -> Iterator[str]:
        """The texts of the leaves in order."""
        waiting = [self]
        while waiting:
            rope = waiting.pop()
            if rope.left is None:
                yield rope.text
            else:
                waiting += [rope.right, rope.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __add__(self, other: Rope) -> Rope:
        """Both in order; heights of siblings differ by one at most if they do in both."""
        if not self.chars or not other.chars:
            return self if self.chars else other
        if self.height > other.height + 1:
            return balanced(self.left, self.right + other)
        if other.height > self.height + 1:
            return balanced(self + other.left, other.right)
        return Rope(left=self, right=other)

    def split(self, rank: int) -> tuple[Rope, Rope]:
        """The first units, so many, and the others."""
        if self.left is None:
            at = rank if self.starts is None else self.starts[rank] if rank < self.units else self.chars
            if self.starts is None:
                return Rope(self.text[:at]), Rope(self.text[at:])
            return Rope(self.text[:at], self.starts[:rank]), Rope(self.text[at:], [s - at for s in self.starts[rank:]])
        if rank <= self.left.units:
            a, b = self.left.split(rank)
            return a, b + self.right
        a, b = self.right.split(rank - self.left.units)
        return self.left + a, b

    def find(self, part: str, start: int = 0) -> int:
        """The code point at which a part first stands from start on, across leaves as well; -1 if it doesn't."""
        seen, tail = 0, ""
        for text in self.leaves():
            held = tail + text
            at = held.find(part, max(0, start - (seen - len(tail))))
            if at >= 0:
                return seen - len(tail) + at
            seen += len(text)
            tail = held[max(0, len(held) - len(part) + 1) :]
        return -1


def balanced(left: Rope, right: Rope) -> Rope:
    """Two ropes of heights that differ by two at most under one node, rotated if they do by two."""
    if left.height > right.height + 1:
        if left.left.height < left.right.height:
            left = Rope(left=Rope(left=left.left, right=left.right.left), right=left.right.right)
        return Rope(left=left.left, right=Rope(left=left.right, right=right))
    if right.height > left.height + 1:
        if right.right.height < right.left.height:
            right = Rope(left=right.left.left, right=Rope(left=right.left.right, right=right.right))
        return Rope(left=Rope(left=left, right=right.left), right=right.right)
    return Rope(left=left, right=right)


def cut(text: Rope, first: int, second: int, suffix_first: bool) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, of the middle): the text cut after first and second units, first <= second, in the order prefix, suffix, middle, or suffix, prefix, middle."""
    head, suffix = text.split(second)
    prefix, middle = head.split(first)
    p, s, m = map(Rope, SENTINELS)
    front = s + suffix + (p + prefix) if suffix_first else p + prefix + (s + suffix)
    return front + (m + middle), prefix.chars, middle.chars


def restore(output: Rope, form: str) -> Rope:
    """The text of an output of form plain, psm or spm; units of the output must be code points."""
    if form == "plain":
        return output
    p, s, m = SENTINELS
    one, two = (s, p) if form == "spm" else (p, s)
    if not next(output.leaves()).startswith(one):
        raise ValueError(f"an output of form {form} must begin with {one}")
    at = output.find(two, len(one))
    end = output.find(m, at + len(two)) if at >= 0 else -1
    if end < 0:
        raise ValueError(f"an output of form {form} must have {two} and {m}")
    front, middle = output.split(end)
    a, b = front.split(at)
    a, b, middle = a.split(len(one))[1], b.split(len(two))[1], middle.split(len(m))[1]
    return b + middle + a if form == "spm" else a + middle + b


CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def fim_column(text: Column, draws: Column, unit: str | None = None) -> Column:
    """The struct CUT of a whole text. draws: an array of four longs that choose both cuts, plain or not, and the order; unit: a pattern of units, code points if None. Null texts are empty, and empty texts plain."""
    names = [x.split()[0] for x in CUT.split(", ")]

    @F.pandas_udf(CUT)
    def made(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = None if unit is None else re.compile(unit, re.DOTALL)
        for texts, numbers in frames:
            out = []
            for t, (h1, h2, h3, h4) in zip(texts, numbers):
                t = t or ""
                rope = Rope.of(t, pattern)
                n = rope.units
                if not t or any(s in t for s in SENTINELS) or h3 % 100 >= CUT_OF_100:
                    out.append((n, "plain", None, None, t))
                    continue
                suffix_first = h4 % 100 < SUFFIX_FIRST_OF_100
                rope, prefix, middle = cut(rope, *sorted((h1 % (n + 1), h2 % (n + 1))), suffix_first)
                out.append((n, "spm" if suffix_first else "psm", prefix, middle, str(rope)))
            yield pd.DataFrame(out, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return made(text, draws)


def restored_column(output: Column, form: Column) -> Column:
    """The text that an output and its form show; null where either is."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else str(restore(Rope.of(o), f)) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)


def draws_of(key: Column, salt: str = SALT) -> Column:
    """Four numbers that hang on a key alone: the first groups of eight digits of the SHA-256 of salt and key, in decimal. A null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, unit: str | None = None, salt: str = SALT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """({id_col}, CUT's columns): a row for each row of docs; rows of one id are cut alike, so that a lost task gives the same rows again. Repeated rows and null ids stay; other columns aren't returned."""
    return docs.select(F.col(id_col), fim_column(F.col(text_col).cast("string"), draws_of(F.col(id_col), salt), unit).alias("_c")).select(id_col, "_c.*")


def restore_texts(cuts: DataFrame) -> DataFrame:
    """The rows of fill_in_middle() with a column text in place of output and form."""
    return cuts.withColumn("text", restored_column(F.col("output"), F.col("form"))).drop("output", "form")


def op12(docs: DataFrame) -> DataFrame:
    """The digest of fill_in_middle() and its inverse that op12_fill_in_middle returns."""
    made = fill_in_middle(docs).withColumn("_text", restored_column(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("_text", 256).alias("restored_sha256"))


_DRAWS = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
_HELD = " OR ".join(f"contains(text, '{s}')" for s in SENTINELS)
_P, _S, _M = SENTINELS
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SALT}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, length(text)::BIGINT AS n, {_DRAWS} FROM d),
f AS (
  SELECT *, CASE WHEN text = '' OR {_HELD} OR h3 % 100 >= {CUT_OF_100} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_OF_100} THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b
  FROM h
),
c AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle ELSE '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
