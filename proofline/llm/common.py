"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused
from ..sources.tables import discard, settle, shared_dir, shared_root

__all__ = ["LOWER", "UPPER", "WORD_GAP", "Memo", "ascii_lower", "cuts", "discard", "fold", "labelled", "labelled_sample", "lookup", "settle", "shared_dir", "shared_root", "unused", "words"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys that lookup() broadcasts, at most.
MOST_CROWDED = 20_000

#: What separates words: every ASCII character that is neither a digit nor a lower-case letter (after ascii_lower).
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of ASCII only (as many bytes as characters) take the faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a whole text as an array; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def fold(doc_id: Column) -> Column:
    """The id's fold of five: 0 is held out and never learned from. A null id has no fold and isn't learned from either."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def lookup(rows: DataFrame, table: DataFrame, key: str, crowd: str) -> DataFrame:
    """rows joined with table on a key that table has once and that is never null; crowd is a boolean column of table that marks keys which a great many rows have. It isn't returned.

    Up to MOST_CROWDED such keys are broadcast with what table has of them, so that their rows stay where they are; the other rows meet table by a shuffle in which no key is crowded. Both tables are read more than once: they should be written ones.
    """
    plain, crowded = table.where(~F.col(crowd)).drop(crowd), table.where(F.col(crowd)).drop(crowd)
    n = crowded.limit(MOST_CROWDED + 1).count()
    if n == 0 or n > MOST_CROWDED:
        return rows.join(table.drop(crowd), key)
    spread = rows.join(F.broadcast(crowded), key)
    return spread.unionByName(rows.join(F.broadcast(crowded.select(key)), key, "left_anti").join(plain, key))


def cuts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs whose sizes sum to most or just beyond."""
    lo = held = 0
    for hi, size in enumerate(sizes, 1):
        held += size
        if held >= most or hi == len(sizes):
            yield lo, hi
            lo, held = hi, 0


class Memo:
    """What a function gives for short strings, remembered. At size strings they become the older half, and the half before is forgotten: what is asked for often stays.

    compute takes a list of distinct strings and gives a list of bytes; strings longer than longest are computed each time.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], size: int, longest: int = 64):
        self.compute, self.size, self.longest = compute, size, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        if len(self.known) > self.size:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [*map(known.get, keys)]
        missing = [i for i, value in enumerate(found) if value is None]
        new = {keys[i] for i in missing}
        got = {k: older[k] for k in new if k in older}
        if unknown := [k for k in new if k not in got]:
            got.update(zip(unknown, self.compute(unknown)))
        for i in missing:
            found[i] = got[keys[i]]
        known.update((k, v) for k, v in got.items() if len(k) <= self.longest)
        return found


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(_id, y): the labels to learn from, those outside the held-out fold. Null ids, null labels and labels other than 0 and 1 aren't used; repeats count once."""
    return labels.where((fold(F.col("doc_id")) != 0) & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, y) of at most per_class labelled documents of either class outside the held-out fold.

    The documents are those whose ids hash lowest, so the choice is the same on every run. Only the chosen ids, 2 * per_class
    at most, are broadcast; texts never move. An id that repeats among the documents brings one of its texts.
    """
    known = labelled(labels, label).join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ids, "_id").groupBy("_id", "y").agg(F.max("text").alias("text")).select("text", "y")
