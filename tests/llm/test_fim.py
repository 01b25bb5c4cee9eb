"""Ropes against strings, and cuts that are put back."""

import hashlib
import random
import re

import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from proofline.llm import fim
from proofline.llm.fim import Rope

TEXT = st.text(st.sampled_from("ab <PSM>é\U0001f600\n"), max_size=60)


def plain(doc_id, text):
    """op12's digest of a document, by slices of strings."""
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


def balanced(rope):
    return rope.left is None or abs(rope.left.height - rope.right.height) <= 1 and balanced(rope.left) and balanced(rope.right) and rope.chars == len(str(rope))


@given(TEXT, st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_ropes_are_strings(text, ranks, leaf):
    rope = Rope.of(text, leaf=leaf)
    assert str(rope) == text and rope.chars == rope.units == len(text) and balanced(rope)
    for rank in ranks:
        rank = min(rank, rope.units)
        a, b = rope.split(rank)
        assert (str(a), str(b)) == (str(rope)[:rank], str(rope)[rank:]) and balanced(a) and balanced(b)
        rope = b + a
        assert balanced(rope)
    for part in ("<P>", "<S>", "a", "ab ", "éa"):
        assert rope.find(part) == str(rope).find(part) and rope.find(part, 3) == str(rope).find(part, 3)


@given(TEXT, st.integers(1, 9), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_units_of_a_pattern(text, leaf, rank):
    pattern = re.compile(r"\S+|\n")
    rope = Rope.of(text, pattern, leaf)
    starts = [m.start() for m in pattern.finditer(text)]
    assert str(rope) == text and rope.units == (max(1, len(starts)) if text and starts else len(starts)) or not starts
    rank = min(rank, rope.units)
    a, b = rope.split(rank)
    cut = len(text) if rank >= rope.units else 0 if rank == 0 else starts[rank]
    assert (str(a), str(b)) == (text[:cut], text[cut:]) and a.units == rank and b.units == rope.units - rank


@given(TEXT, st.integers(0, 60), st.integers(0, 60), st.booleans())
@settings(max_examples=300, deadline=None)
def test_cuts_are_put_back(text, x, y, suffix_first):
    if any(s in text for s in fim.SENTINELS):
        return
    a, b = sorted((x % (len(text) + 1), y % (len(text) + 1)))
    rope, prefix, middle = fim.cut(Rope.of(text, leaf=4), a, b, suffix_first)
    assert (prefix, middle) == (a, b - a)
    assert str(fim.restore(Rope.of(str(rope), leaf=5), "spm" if suffix_first else "psm")) == text


def test_documents(spark):
    rng = random.Random(3)
    rows = [*awkward(), (50, "has <P> in it"), (51, "<S"), (52, "<<P>"), (53, "x<"), (54, "a" * 1_000_000)] + [(100 + i, "".join(rng.choice("ab<PSM>é\U0001f600 \n") for _ in range(rng.randrange(40)))) for i in range(300)]
    got = sorted(map(str, (tuple(r) for r in fim.op12(documents(spark, rows)).collect())))
    assert got == sorted(map(str, (plain(*r) for r in rows)))
    assert fim.op12(documents(spark, [])).count() == 0


def test_words_as_units(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 17))) for i in range(200)]
    made = fim.fill_in_middle(documents(spark, rows), unit=r"\S+\s*")
    assert all(r["n"] == r["doc_id"] % 17 for r in made.collect()) and {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    assert sorted((r["doc_id"], r["text"]) for r in fim.restore_texts(made).collect()) == rows
    cut = [r for r in made.collect() if r["form"] == "psm"]
    assert all(not r["output"].split("<S>")[0].endswith("w") for r in cut)


@pytest.mark.parametrize("output, form", [("no sentinel", "psm"), ("<P>a<M>b", "psm"), ("<S>a<P>b", "spm")])
def test_what_is_no_output_raises(output, form):
    with pytest.raises(ValueError):
        fim.restore(Rope.of(output), form)
