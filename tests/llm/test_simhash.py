"""Fingerprints, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from helpers import LOWER, awkward, documents
from pyspark.sql import functions as F

from proofline.llm import simhash


def plain(text):
    w = [x for x in "".join((text or "").translate(LOWER)).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(nodes, distance=2):
    """node -> smallest fingerprint of its component, by all pairs."""
    nodes = sorted(nodes)
    a = np.array(nodes, np.uint64)
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in nodes:
        for y in a[np.bitwise_count(a ^ np.uint64(x)) <= distance].tolist():
            label[max(find(x), find(y))] = min(find(x), find(y))
    return {x: find(x) for x in nodes}


def wanted(rows):
    fp = [plain(t) for _, t in rows]
    of = components(set(fp))
    least = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    return sorted((str(d), f"{f:016x}", str(least.get(of[f]))) for (d, _), f in zip(rows, fp))


def run(spark, rows):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.op7(documents(spark, rows)).collect())


def test_documents(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    rows = awkward() + [(100 + i, t) for i, t in enumerate(base)]
    for i in range(120):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 - i, " ".join(w) if i % 3 else " ".join(w).upper().replace("CHANGED", "changed")))
    assert run(spark, rows) == wanted(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, None), (2, ""), (None, " ")]) == [("2", "0" * 16, "2"), ("3", "0" * 16, "2"), ("None", "0" * 16, "2")]


@pytest.mark.parametrize("limit", [1, 3, 32])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_of_crowded_keys(spark, limit, distance):
    """Many fingerprints a bit or two apart: linked the same whichever way a key is taken."""
    rng = random.Random(limit)
    values = {0, (1 << 64) - 1}
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(25):
            v ^= 1 << rng.randrange(64)
            values.add(v)
        values |= {v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(10)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    pairs = simhash.close_pairs(spark.createDataFrame(signed, "fp long"), distance, limit)
    label = {r["node"]: r["label"] for r in simhash.components(pairs).collect()}
    own = components(values, distance)
    groups = lambda m: {frozenset(k for k in m if m[k] == g) for g in m.values()}
    got = {v: label.get(s, s) for v, (s,) in zip(values, signed)}
    assert groups(got) == groups(own)


def test_long_chain(spark):
    """A path whose ends are far apart is one component."""
    values = [(1 << i) - 1 for i in range(60)]
    pairs = simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), 2, 4)
    assert len({r["label"] for r in simhash.components(pairs).collect()}) == 1


def test_wide_fingerprints_by_their_definition():
    """Bit by bit, from a text's shingles."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 3, 5, 40, 700)] + [None, "", "A  b\nC", "a b c"]
    numbers = ((2, 2), (5, 1))
    got = simhash.wide_fingerprints(texts, numbers)
    most = (1 << 64) - 1
    for text, row in zip(texts, got.tolist()):
        w = [xxhash.xxh64_intdigest(x.encode()) for x in (text or "").translate(LOWER).split()]
        k = 0
        for size, many in numbers:
            found = []
            for i in range(max(1, len(w) - size + 1) if w else 0):
                h = w[i]
                for x in w[i + 1 : i + size]:
                    h = ((h ^ h >> 31) * 0xBF58476D1CE4E5B9 + x) & most
                found.append(h)
            for _ in range(many):
                k += 1
                mixed = []
                for h in found:
                    z = (h + k * 0x9E3779B97F4A7C15) & most
                    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & most
                    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & most
                    mixed.append(z ^ z >> 31)
                assert row[k - 1] == sum(1 << b for b in range(64) if sum(z >> b & 1 for z in mixed) * 2 > len(mixed))
    assert (got[-1] == got[-2]).all() and not got[-3].any() and not got[-4].any()


def test_near_copies_of_one_text(spark):
    """A large group of copies with scattered edits is one class, whatever its blocks hold; other texts stay by themselves."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    first = [word() for _ in range(400)]
    rows = [(0, " ".join(first))]
    for i in range(1, 1500):
        w = list(first)
        for _ in range(6):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(10_000 + i, " ".join(word() for _ in range(200))) for i in range(300)]
    each = documents(spark, rows).select(F.col("doc_id").alias("key"), simhash.wide_fingerprint_column(F.col("text")).alias("fp"))
    got = {r["key"]: r["component"] for r in simhash.similar_classes(each).collect()}
    copies = [got[i] for i in range(1500) if i in got]
    assert sum(c == got[0] for c in copies) >= 0.98 * len(copies)
    assert len({got[10_000 + i] for i in range(300)}) == 300 and got[0] not in {got[10_000 + i] for i in range(300)}


def family(pairs, own, apart, rng, words=400):
    """Pairs of near copies of texts from one template: each pair's first text has `own` words of its own, its second `apart` more."""
    word = lambda: f"w{rng.randrange(100_000)}"
    template, rows = [word() for _ in range(words)], []
    for p in range(pairs):
        first = list(template)
        for i in rng.sample(range(words), own):
            first[i] = word()
        second = list(first)
        for i in rng.sample(range(words), apart):
            second[i] = word()
        rows += [(2 * p, " ".join(first)), (2 * p + 1, " ".join(second))]
    return rows


def by_all_pairs(fps, similarity=0.8):
    """The components of wide fingerprints that share a block and whose sketches show the similarity, by comparing all."""
    a = np.array(fps, np.int64).view(np.uint64)
    mask, wide = np.uint64((1 << simhash.BLOCK_BITS) - 1), simhash.BLOCKS[1]
    blocks, sketches = np.concatenate([a[:, :wide] >> np.uint64(32) & mask, a[:, :wide] & mask], axis=1), a[:, wide:]
    label = list(range(len(a)))

    def find(x):
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for x in range(len(a)):
        near = (blocks == blocks[x]).any(1) & (np.bitwise_count(sketches ^ sketches[x]).sum(1) <= simhash.bits_apart(similarity))
        for y in np.flatnonzero(near).tolist():
            label[find(y)] = find(x)
    return [find(x) for x in range(len(a))]


@pytest.mark.parametrize("pairs, own, apart, least", [(600, 7, 4, 0.99), (1500, 9, 4, 0.99), (1500, 10, 7, 0.95), (1500, 10, 8, 0.9)])
def test_families_of_one_template(spark, pairs, own, apart, least):
    """Blocks are crowded with texts that aren't near copies: the components are those of all pairs that share a block, none is lost, and pairs of a similarity from 0.82 to 0.91 are joined."""
    rows = family(pairs, own, apart, random.Random(pairs + own))
    each = simhash.settle(documents(spark, rows).select(F.col("doc_id").alias("key"), simhash.wide_fingerprint_column(F.col("text")).alias("fp")))
    got = {r["key"]: r["component"] for r in simhash.similar_classes(each).collect()}
    fps = {r["key"]: r["fp"] for r in each.collect()}
    wanted = dict(zip(fps, by_all_pairs(list(fps.values()))))
    assert len({(got[k], wanted[k]) for k in fps}) == len(set(got.values())) == len(set(wanted.values()))
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(pairs)) >= least * pairs


def test_blocks_of_many_chunks(spark, monkeypatch):
    """A block's chunks meet each other whatever their number."""
    rows = family(150, 5, 6, random.Random(3), words=200)
    each = simhash.settle(documents(spark, rows).select(F.col("doc_id").alias("node"), simhash.wide_fingerprint_column(F.col("text")).alias("fp")))
    members = simhash.block_members(each)
    none = spark.createDataFrame([], "node long, label long")
    fps = {r["node"]: r["fp"] for r in each.collect()}
    wanted = dict(zip(fps, by_all_pairs(list(fps.values()))))
    for chunk in (7, 64, 4096):
        links = simhash.left_links(each, members, none, 0.8, 1, chunk)
        label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
        got = {k: label.get(k, k) for k in fps}
        assert len({(got[k], wanted[k]) for k in fps}) == len(set(got.values())) == len(set(wanted.values()))


def test_crowded_keys_are_looked_up(spark):
    rows = spark.range(9000).select((F.col("id") % 3000).alias("x"), F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("fp"))
    table = spark.createDataFrame([(7, "seven", True), (5000, "other", False), (6000, "crowd", True)], "fp long, name string, crowd boolean")
    got = simhash.lookup(rows, table, "fp", "crowd")
    assert {r["name"]: r["count"] for r in got.groupBy("name").count().collect()} == {"seven": 4000, "other": 1, "crowd": 1} and got.columns == ["fp", "x", "name"]
