"""Small tables with everything awkward in them."""

from __future__ import annotations

import random
import re

#: Names that operators use inside.
CLASHING = ["_id", "_w", "_h", "_fp", "fp", "key", "id", "n", "start", "words", "items", "node", "label", "b", "q", "v", "y", "score"]
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def documents(spark, rows, clash=True):
    """rows: (doc_id, text). With clash: further columns whose names operators use inside, some null."""
    names = [c for c in CLASHING if clash]
    return spark.createDataFrame([(*r, *[None if i % 2 else f"x{i}" for i in range(len(names))]) for r in rows], "doc_id long, text string" + "".join(f", `{c}` string" for c in names))


def awkward():
    """Null and empty texts, repeats, a null id, a long text, marks only, other scripts."""
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "Delta", "éta", "ñu", "x1", "日本"]
    long = " ".join(rng.choice(vocabulary) for _ in range(6000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "Hello, World"), (4, "Hello, World"), (None, "Hello, World"), (5, "... !!! ???"), (6, long), (7, "日本語 テキスト ﬁ é ▁ \U0001f600"), (8, "a"), (-9, "ABC abc ÀÉ àé")]
