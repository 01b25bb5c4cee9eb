"""Repair of conversations against plain searches: every cheapest edit of short ones, and a turn at a time for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from helpers import CLASHING

from proofline.llm import turns

SF = "/root/testdata/sf0.01"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        if last:
            seen.add((role, text))
    return out


def cheapest(initials, found):
    """(cost, audit, initials that are left) by a search forward that keeps the best of each state; the state is what is left so far, by its last initial."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", "")}

    def inserted(b):
        for _ in range(3):
            for at, (c, e, left) in list(b.items()):
                for x in "ua":
                    if (at, x) in step and (step[at, x] not in b or (c + 5, e + "I") < b[step[at, x]][:2]):
                        b[step[at, x]] = (c + 5, e + "I", left + x)
        return b

    for initial, fault in zip(initials, found):
        after = {}
        late = 5 if fault == "truncated" else 0

        def offer(to, value):
            if to not in after or value[:2] < after[to][:2]:
                after[to] = value

        for at, (c, e, left) in inserted(best).items():
            offer(at, (c + 2, e + "D", left))
            if fault not in ("blank", "duplicate"):
                if (at, initial) in step:
                    offer(step[at, initial], (c + late, e + "K", left + initial))
                for x in "ua":
                    if (at, x) in step:
                        offer(step[at, x], (c + late + 1, e + "R", left + x))
        best = after
    return min((v for at, v in inserted(best).items() if at in ("", "a")), key=lambda v: v[:2])


def plain(rows):
    """op11's digest, conversation by conversation."""
    out = []
    damaged = damage(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, key(r[2], r[3])))
        found, initials = faults(own), [r[2][:1] for r in own]
        cost, audit, left = cheapest(initials, found)
        assert GRAMMAR.match(left)
        said, i, j = [], 0, 0
        for letter in audit:
            if letter == "I":
                said.append({"u": "user", "a": "assistant"}[left[j]] + ":")
            elif letter != "D":
                said.append((own[i][2] if letter == "K" else {"u": "user", "a": "assistant"}[left[j]]) + ":" + own[i][3])
            i, j = i + (letter != "I"), j + (letter != "D")
        there = [r[1] for r in own if r[1] is not None]
        gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((c, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    names = [c for c in [*CLASHING, "conv", "seg", "place", "uid", "code", "turns"] if c not in ("conv_id", "turn", "role", "text")]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "conv_id long, turn long, role string, text string" + "".join(f", `{c}` string" for c in names))


def run(spark, rows, **more):
    got = turns.op11(frame(spark, rows), **more)
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got.collect()), key=str)


def some(rng, conversations, most):
    text = lambda: rng.choice(["Yes.", "No!", "Why?", "cut", "  ", "", "a\nb. ", "é ñ?", None, f"t{rng.randrange(9)}."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "under"])
    return [(c, rng.choice([i, i, i, i + rng.randrange(3), None]), role(), text()) for c in range(conversations) for i in range(rng.randrange(most))]


def brute(initials, found):
    """(cost, audit) of the best of all edits, with up to two insertions in a place."""
    best = None

    def go(i, cost, audit, left):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(initials):
            for tail in ("", "u", "a", "ua"):
                if GRAMMAR.match(left + tail):
                    value = (cost + 5 * len(tail), audit + "I" * len(tail))
                    best = value if best is None or value < best else best
            return
        late = 5 if found[i] == "truncated" else 0
        for before in ("", "u", "a", "ua", "au"):
            c, e, so_far = cost + 5 * len(before), audit + "I" * len(before), left + before
            go(i + 1, c + 2, e + "D", so_far)
            if found[i] not in ("blank", "duplicate"):
                go(i + 1, c + late, e + "K", so_far + (initials[i] or "?"))
                for x in "ua":
                    go(i + 1, c + late + 1, e + "R", so_far + x)

    go(0, 0, "", "")
    return best


def test_the_plain_search_finds_the_best_of_all():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(5)
        initials, found = [rng.choice("suat") for _ in range(n)], [rng.choice([None, None, "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert cheapest(initials, found)[:2] == brute(initials, found), (initials, found)


@pytest.mark.parametrize("segment", [4, 4096])
def test_conversations(spark, segment):
    rows = some(random.Random(segment), 150, 14)
    assert run(spark, rows, segment=segment) == plain(rows)


def test_one_conversation_of_many_segments(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b?", f"c{i}.", f"d{i}"])) for i in range(6000)] + some(rng, 20, 9)
    assert run(spark, rows, segment=64) == plain(rows)


def test_awkward_rows(spark):
    long = "word " * 100_000 + "end."
    rows = [(None, None, None, None), (None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "Hi."), (7, None, "user", "Hi."), (7, 2, "assistant", long), (7, 2, "assistant", long), (8, 5, "", ""), (9, 3, "user", "x" * 100_000), (-1, 0, "system", "Only.")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_a_conversation_of_which_nothing_is_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes."), (1, 4, "user", ""), (1, 5, "user", "Hi.")]
    got = turns.repair_conversations(frame(spark, rows), segment=2).orderBy("seg", "at").collect()
    assert [(r["letter"], r["turn"], r["role"]) for r in got] == [("K", 0, "system"), ("D", 1, None), ("K", 2, "user"), ("K", 3, "assistant"), ("D", 4, None), ("D", 5, None)]
    # Whatever is left is a conversation, whatever was given.
    made = turns.repair_conversations(frame(spark, some(random.Random(8), 80, 12)), segment=4).orderBy("conv_id", "seg", "at").collect()
    for _, own in itertools.groupby(made, key=lambda r: r["conv_id"]):
        assert GRAMMAR.match("".join(r["role"][0] for r in own if r["letter"] != "D"))


def test_matrices_are_the_costs_of_each_way_through():
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, 16, rng.integers(1, 9)).astype(np.uint8) for _ in range(200)]
    for a, b in zip(codes, codes[1:]):
        m, n, both = turns.segment_matrices([a, b, np.concatenate([a, b])])
        joined = (m[:, :, None] + n[None]).min(1)
        assert np.array_equal(np.minimum(joined, 1 << 20), np.minimum(both, 1 << 20))


def test_a_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = sorted((tuple(r) for r in turns.op11(table).collect()), key=str)
    assert got == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
