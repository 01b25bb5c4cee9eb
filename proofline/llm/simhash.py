"""Near-duplicate groups by SimHash fingerprints.

Fingerprints are computed in Arrow batches, one per document; everything after works on distinct fingerprints, so that a large group
of copies is one row. The 64 bits are cut into 5 blocks; two fingerprints that differ in at most 2 bits agree in 3 of them, so each is
dealt out under its 10 triples of blocks, and pairs under one key are verified by their Hamming distance. A key with more than
PAIRS_UP_TO fingerprints (near copies that differ by a bit here and there) would give the square of its size in pairs. Its members are
linked by balls instead: two fingerprints differ in at most 2 bits exactly if some value is within 1 bit of both, so each is dealt out
under the 65 values within 1 bit of it and linked to the smallest that shares one. No such group has more than 65 members, and no
link is lost.

Near copies with edits all over differ in more bits than any exact search of 64-bit fingerprints can reach. similar_classes() takes wide fingerprints for them: blocks of 32 bits,
one of which close pairs share (here with high probability, not with certainty), and a sketch of five-word shingles whose Hamming distance verifies the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cuts, discard, lookup, settle

PAIRS_UP_TO = 32
#: A worker forgets its words' hashes beyond so many.
CACHE = 200_000
#: A wide fingerprint's parts as (words of a shingle, 64-bit numbers): blocks to find candidates by, two of 32 bits in each number, and the sketch that verifies them.
BLOCKS, SKETCH = (2, 24), (5, 16)
#: Bits of a block.
BLOCK_BITS = 28
#: In blocks with more than CROWDED members each is compared with a hub first, the one in most company; then what isn't in one group yet is compared, CHUNK members of a block against as many at a time.
CROWDED, CHUNK = 8, 2048
#: Whom links are joined with apart: nodes with more links than this.
HEAVY = 1000


def bits_apart(similarity: float, bits: int = 64 * SKETCH[1], deviations: float = 1.0) -> int:
    """In how many bits fingerprints of shingle sets of this Jaccard similarity differ: by the angle between such sets, and some standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a whole text, unsigned: bit i is set if it is in more than half of the shingles' XXH64 hashes. Without words it is 0; fewer words than a shingle are one."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()][: len(parts) - shingle + 1]
    counts, n = np.zeros(64, np.int64), len(starts)
    for lo in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 16)], (ends[shingle - 1 + lo : shingle - 1 + lo + (1 << 16)] - 1).tolist())], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text as a signed long; null and empty texts have 0."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash64(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    return fp(text)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


#: Byte -> its bits, each in a byte of its own, so that up to 255 of them add up in one number.
_SPREAD = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(np.uint64).ravel()
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def wide_fingerprints(texts: list[str | None], numbers: tuple[tuple[int, int], ...], hashes: dict | None = None) -> np.ndarray:
    """SimHash fingerprints of many bits: a row of 64-bit numbers for each text. numbers: (words of a shingle, how many numbers of its own) for each part of a row.

    Words are what white space parts, A-Z lower-cased; a text of fewer words than a shingle is one, one without words has zeros. Bit i is set if it is in more than half of the shingles' i-th hash bits.
    """
    hashes = _Hashes() if hashes is None else hashes
    found = [np.fromiter(map(hashes.__getitem__, (t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()), np.uint64) for t in texts]
    out = np.zeros((len(texts), sum(n for _, n in numbers)), np.uint64)
    some = np.flatnonzero([len(w) for w in found])
    if not len(some):
        return out
    first = 0
    for shingle, many in numbers:
        rows = []
        for i in some.tolist():
            w, size = found[i], min(shingle, len(found[i]))
            h = w[: len(w) - size + 1]
            for k in range(1, size):
                h = (h ^ h >> np.uint64(31)) * _MIX[1] + w[k : len(w) - size + 1 + k]
            rows.append(h)
        sizes = np.array([len(h) for h in rows])
        every = np.concatenate(rows)
        parts = -(-sizes // 255)  # a text's shingles, 255 at a time
        begin = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        own = np.cumsum(parts) - parts
        for k in range(many):
            z = every + np.uint64(int(_MIX[0]) * (first + k + 1) % (1 << 64))
            z = (z ^ z >> np.uint64(30)) * _MIX[1]
            z = (z ^ z >> np.uint64(27)) * _MIX[2]
            z ^= z >> np.uint64(31)
            columns = z.view(np.uint8).reshape(-1, 8)
            bits = np.zeros((len(rows), 64), bool)
            for c in range(8):
                sums = np.add.reduceat(_SPREAD[columns[:, c]], begin).view(np.uint8).reshape(-1, 8)
                bits[:, 8 * c : 8 * c + 8] = np.add.reduceat(sums, own, axis=0, dtype=np.uint32) * 2 > sizes[:, None]
            out[some, first + k] = np.packbits(bits, axis=1).view(np.uint64).ravel()
        first += many
    return out


def _masks(distance: int) -> list[int]:
    """Masks of the blocks that a key keeps: distance + 3 blocks, all but distance of them."""
    blocks = np.array_split(np.arange(64), distance + 3)
    return [sum(1 << int(i) for b in pick for i in b) for pick in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fps: DataFrame, distance: int = 2, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Links (a, b), a < b as signed longs, between the distinct fingerprints in column fp; all fingerprints within the distance are connected through them, by themselves or, in crowded keys, by the ball of a third value.

    The exact way for crowded keys needs distance 2 or less.
    """
    if distance > 2:
        raise ValueError("crowded keys can be linked exactly up to distance 2 only")
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(_masks(distance))])
    keyed = fps.select("fp").distinct().select("fp", F.explode(masks).alias("x")).select("fp", F.col("x.i").alias("i"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    # One shuffle by key gathers a key's fingerprints up to the bound; how many there are decides the way.
    sizes = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.join(sizes, ["i", "key"])
    a = members.where(F.col("n") <= pairs_up_to).groupBy("i", "key").agg(F.array_sort(F.collect_list("fp")).alias("v"))
    near = a.select(F.posexplode("v").alias("at", "a"), "v").select("a", F.explode(F.expr(f"filter(slice(v, at + 2, size(v)), b -> bit_count(a ^ b) <= {distance})")).alias("b"))
    crowded = members.where(F.col("n") > pairs_up_to).select("fp").distinct()
    # Flips of one bit reach distance 2, flips of none distance 0; at distance 1 a pair is a value and its flip.
    flips = F.array(*[F.lit(_signed(m)).cast("long") for m in [0, *(1 << i for i in range(64))]])
    balls = crowded.select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    ball = balls.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("v")).where(F.size("v") > 1)
    if distance == 2:
        linked = ball.select(F.element_at("v", 1).alias("a"), F.explode(F.slice("v", 2, F.size("v"))).alias("b"))
    else:
        linked = ball.select(F.col("key").alias("a"), F.explode("v").alias("b")).where(f"a <> b and bit_count(a ^ b) <= {distance}").join(crowded.select(F.col("fp").alias("a")), "a", "left_semi")
        linked = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.unionByName(linked).distinct()


def wide_fingerprint_column(text: Column) -> Column:
    """The wide fingerprint of a text as an array of longs, BLOCKS before SKETCH; null and empty texts have zeros."""

    @F.pandas_udf("array<long>")
    def wide(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Hashes()
        for f in frames:
            texts, out = f.tolist(), []
            for lo, hi in cuts([len(t or "") for t in texts], 1 << 20):
                out.extend(wide_fingerprints(texts[lo:hi], (BLOCKS, SKETCH), hashes).view(np.int64))
            yield pd.Series(out, dtype=object)

    return wide(text)


def block_members(classes: DataFrame) -> DataFrame:
    """(node, s, i, v, n): the blocks of classes (node, fp) that others share, with the number of their members and the first 64 bits of each one's sketch. Written once."""
    mask = F.lit((1 << BLOCK_BITS) - 1)
    blocks = F.flatten(F.transform(F.slice("fp", 1, BLOCKS[1]), lambda x: F.array(F.shiftrightunsigned(x, 32).bitwiseAND(mask), x.bitwiseAND(mask))))
    keyed = classes.select("node", F.get("fp", F.lit(BLOCKS[1])).alias("s"), F.posexplode(blocks).alias("i", "v"))
    sizes = keyed.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return settle(keyed.join(sizes, ["i", "v"]))


def similar_pairs(classes: DataFrame, members: DataFrame, similarity: float, pairs_up_to: int = CROWDED) -> DataFrame:
    """Links (a, b), a < b, between rows of classes (node, fp) whose sketches show the similarity: of all that share a block of at most pairs_up_to members, and of each member of a larger one with its hub.

    The sketch's first 64 bits travel with each block, and tell apart nearly all that share one by chance (one in a hundred thousand that should pass differs in more of them); only the rest is
    compared by whole sketches. The hub is the member in most company, which of copies of one text is the text that they were made from: it makes such a group one with few links.
    """
    first = bits_apart(similarity, 64, 4.5)
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= first
    few = members.where(F.col("n") <= pairs_up_to).groupBy("i", "v").agg(F.array_sort(F.collect_list(F.struct("node", "s"))).alias("m"))
    near = few.select(F.posexplode("m").alias("at", "x"), "m")
    near = near.select(F.col("x.node").alias("a"), F.explode(F.filter(F.slice("m", F.col("at") + 2, F.size("m")), lambda y: close(F.col("x")["s"], y["s"]))["node"]).alias("b"))
    many = members.where(F.col("n") > pairs_up_to)
    company = many.groupBy("node").agg(F.sum("n").alias("company"))
    top = F.max(F.struct("company", (-F.col("node")).alias("x"), "s"))
    hubs = many.join(company, "node").groupBy("i", "v").agg(top.alias("top")).select("i", "v", (-F.col("top.x")).alias("hub"), F.col("top.s").alias("hub_s"))
    far = many.join(hubs, ["i", "v"]).where((F.col("node") != F.col("hub")) & close(F.col("s"), F.col("hub_s"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = near.unionByName(far).distinct()
    sketch = classes.select("node", F.slice("fp", BLOCKS[1] + 1, SKETCH[1]).alias("s"))
    both = pairs.join(sketch.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sketch.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where(apart <= bits_apart(similarity)).select("a", "b")


def links_between(labels: np.ndarray, sketches: np.ndarray, first: np.ndarray, most: int) -> set[tuple[int, int]]:
    """(a, b), a < b: labels that have members within so many bits of each other, compared across all members but those of the most frequent label among themselves. first: which side a member is on; of two sides only members of different ones
    are compared. Labels that are linked already, directly or through others, needn't be found again, so that what is found is a forest.
    """
    kinds, counts = np.unique(labels, return_counts=True)
    if len(kinds) < 2:
        return set()
    of = {int(k): int(k) for k in kinds}

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    two = bool(first.any()) and not first.all()
    rest = np.flatnonzero(labels != kinds[np.argmax(counts)])
    found = set()
    for lo in range(0, len(rest), 64):
        part = rest[lo : lo + 64]
        apart = np.zeros((len(part), len(labels)), np.uint16)
        for k in range(sketches.shape[1]):
            apart += np.bitwise_count(sketches[part, None, k] ^ sketches[None, :, k])
        close = (apart <= most) & (labels[part, None] != labels[None, :])
        if two:
            close &= first[part, None] != first[None, :]
        x, y = np.nonzero(close)
        for a, b in {(int(a), int(b)) for a, b in zip(labels[part[x]], labels[y])}:
            p, q = root(a), root(b)
            if p != q:
                of[max(p, q)] = min(p, q)
                found.add((min(a, b), max(a, b)))
    return found


def left_links(classes: DataFrame, members: DataFrame, label: DataFrame, similarity: float, pairs_up_to: int = CROWDED, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b), a < b, between labels of label (node, label; a node that isn't there is its own): those of members of crowded blocks whose sketches show the similarity, all pairs of labels that a block brings together but for those that others already link.

    What links to hubs has made one group is only compared with what it left out. A block's members come in chunks, each pair of chunks to a task of its own, so that a task holds 2 * chunk sketches whatever the block; what tasks give is a forest of labels.
    """
    blocks = members.where(F.col("n") > pairs_up_to).groupBy("node").agg(F.collect_list(F.struct("i", "v", "n")).alias("blocks"))
    own = blocks.join(classes.select("node", F.slice("fp", BLOCKS[1] + 1, SKETCH[1]).alias("s")), "node").join(label, "node", "left")
    each = own.select(F.coalesce("label", "node").alias("label"), "node", "s", F.explode("blocks").alias("b")).select("label", "s", "b.i", "b.v", F.ceil(F.col("b.n") / chunk).alias("k"), "node")
    mine = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("k"))
    dealt = each.withColumn("c", mine).select("label", "s", "i", "v", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    pairs = dealt.select("i", "v", F.least("c", "other").alias("p"), F.greatest("c", "other").alias("q"), (F.col("c") <= F.col("other")).alias("first"), "label", "s")
    most = bits_apart(similarity)

    def compare(table: pa.Table) -> pa.Table:
        sketches = np.frombuffer(pa.concat_arrays(table["s"].chunks).flatten().to_numpy().tobytes(), np.uint64).reshape(table.num_rows, -1)
        found = sorted(links_between(table["label"].to_numpy(), sketches, table["first"].to_numpy(), most))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return pairs.groupBy("i", "v", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def similar_classes(each: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(key, component): a row for each distinct wide fingerprint of each (key, fp), with its smallest key; those of one component are linked by pairs whose five-word shingles are as similar.

    Keys may be of any type with an order. Rows of one fingerprint, as copies and all texts without words have, are one row here, so that a large group of copies costs no more than a small one.
    Every two that share a block and whose sketches show the similarity are in one component, whatever the block holds.
    """
    classes = settle(each.groupBy("fp").agg(F.min("key").alias("key")).select("key", "fp", F.monotonically_increasing_id().alias("node")))
    members = block_members(classes)
    label = components(similar_pairs(classes, members, similarity))
    further = components(left_links(classes, members, label, similarity))
    discard(members)
    named = classes.select("key", F.col("node").alias("_node")).join(label, F.col("_node") == F.col("node"), "left").select("key", F.coalesce("label", "_node").alias("_label"))
    return named.join(further, F.col("_label") == F.col("node"), "left").select("key", F.coalesce("label", "_label").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of links (a, b).

    In each round every node points to its smallest neighbour if that is smaller than itself, pointers are followed to their ends, and the links between what then is one node are dropped, until no link is
    left. Nodes with more than HEAVY links are looked up by broadcast, so that a star's links don't meet in one task. Each round at least halves the nodes that still have links; each ends in written tables, and what no later round reads is removed.
    """
    edges, labels = settle(links.select("a", "b")), None
    while edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"), (F.count(F.lit(1)) > HEAVY).alias("heavy")))
        moved = True
        while moved:
            # Many may point to one: as many as have links with it.
            further = to.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("heavy").alias("crowd"))
            after = settle(lookup(to, further, "to", "crowd").select("node", F.col("next").alias("to"), "heavy", (F.col("next") != F.col("to")).alias("moved")))
            moved = after.where("moved").limit(1).count() > 0
            discard(to)
            to = after
        ends_of = lambda end: to.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"), F.col("heavy").alias(f"{end}_heavy"))
        left = lookup(lookup(edges, ends_of("a"), "a", "a_heavy"), ends_of("b"), "b", "b_heavy").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        smaller = settle(left)
        if labels is None:
            named = to.select("node", F.col("to").alias("label"))
        else:
            named = labels.join(to.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        kept = settle(named)
        discard(edges, to, *([] if labels is None else [labels]))
        edges, labels = smaller, kept
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def fingerprint_groups(each: DataFrame, distance: int = 2) -> DataFrame:
    """(fp, first_id, component, crowd): a row for each distinct fingerprint of each (fp, doc_id), with its smallest id; component is a fingerprint that names those linked to it, and crowd tells whether more than HEAVY rows have it."""
    classes = settle(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), (F.count(F.lit(1)) > HEAVY).alias("crowd")))
    label = components(close_pairs(classes, distance))
    return classes.join(label, classes.fp == label.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("component"), "crowd")


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs: component_id is the smallest id reachable over links of fingerprints that differ in at most distance bits, itself included.

    Null and empty texts share fingerprint 0 and are linked like any other. A null id gets its group's smallest id, or null if all are null.
    Repeated rows stay repeated. Other columns aren't returned.
    """
    each = settle(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col).cast("string"), shingle).alias("fp")))
    named = fingerprint_groups(each, distance)
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    whole = settle(named.join(first, "component").select("fp", "component_id", "crowd"))
    return lookup(each, whole, "fp", "crowd").select("doc_id", "fp", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    """The digest of simhash_groups() that op7_simhash returns."""
    return simhash_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
