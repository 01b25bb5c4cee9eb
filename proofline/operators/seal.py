"""Sealed documents: canonical hashes, a chain of bindings, and records that are written once."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_sha256, facts, sha256_of
from ..functions.names import unused
from ..sources.tables import discard, settle
from .sets import same_members, same_order


def sealed_hashes(documents: DataFrame, text: str = "text") -> DataFrame:
    """With raw_sha256, canonical_sha256 (null if malformed) and violations."""
    (f,) = unused(documents, "_facts")
    read = documents.withColumn(f, facts(F.col(text)))
    return read.withColumns({"raw_sha256": F.sha2(F.col(text).cast("binary"), 256), "canonical_sha256": F.sha2(F.col(f)["canonical"].cast("binary"), 256), "violations": F.col(f)["violations"]}).drop(f)


def digest(text: Column) -> Column:
    """The 32 bytes of a SHA-256 written as 64 lower-case hex digits; null for any other text."""
    return F.when(text.rlike("^[0-9a-f]{64}\\z"), F.unhex(text))


def followed(now: DataFrame) -> DataFrame:
    """Rows (own, up, kind, flawed, fork), each own once, with every pointer followed to its end. up: the furthest ancestor so far, whose own parent isn't looked at yet; kind: what end it is, null if none; flawed: whether a node on the way is bad; fork: what else makes the node itself bad, told to those that point at it.

    Pointers are doubled: each round lets what a node points to tell where that one points, so that the rounds are the logarithm of the longest chain. A round in which no further node reaches an end leaves circles, and what leads to them, alone: their kind stays null.
    A round writes only the nodes that had no end before it; those that had one stay where they were written.
    """
    ended, open_ = now.where("kind is not null"), now.where("kind is null")
    left = open_.count()
    while left:
        there = ended.unionByName(open_).select(F.col("own").alias("_own"), F.col("up").alias("_up"), F.col("kind").alias("_kind"), F.col("flawed").alias("_flawed"), F.col("fork").alias("_fork"))
        # Sorted and merged at every size: no plan that holds for small tables only.
        met = open_.join(there.hint("merge"), F.col("up") == F.col("_own"))
        further = settle(met.select("own", F.col("_up").alias("up"), F.col("_kind").alias("kind"), (F.col("flawed") | F.col("_fork") | F.col("_flawed")).alias("flawed"), "fork"))
        ended, open_ = ended.unionByName(further.where("kind is not null")), further.where("kind is null")
        before, left = left, open_.count()
        if left == before:
            break
    return ended.unionByName(open_)


def ancestries(nodes: DataFrame) -> DataFrame:
    """(own, root, kind, flawed) of each of nodes (own, parent, bad), each own once: where a node's parents lead to, and whether any node on the way, itself left out, is bad.

    kind: ROOT (root is the hash without a parent), MISSING (the last parent isn't there; root is that parent's hash) or CIRCLE (no end; root is null).
    """
    known = nodes.select(F.col("own").alias("_own"), F.col("parent").alias("_above"), F.col("bad").alias("_bad"))
    met = nodes.join(known, F.col("parent") == F.col("_own"), "left")
    kind = F.when(F.col("parent").isNull(), "ROOT").when(F.col("_own").isNull(), "MISSING").when(F.col("_above").isNull(), "ROOT")
    ends = followed(settle(met.select("own", F.coalesce("parent", "own").alias("up"), kind.alias("kind"), F.coalesce("_bad", F.lit(False)).alias("flawed"), F.lit(False).alias("fork"))))
    return ends.select("own", F.when(F.col("kind").isNotNull(), F.col("up")).alias("root"), F.coalesce("kind", F.lit("CIRCLE")).alias("kind"), "flawed")


# What breaks a link, in the order in which it is looked for.
NO_JSON, CHANGED, SELF, TWICE = "payload is no JSON", "re-derived hash differs from the recorded one", "bound to itself", "another link has the same hash"
UNKNOWN, FORK, CIRCLE, FLAWED, ASTRAY = "parent is not in the chain", "another link is bound to the same parent", "its ancestors run in a circle", "an ancestor is broken", "its root is not the pinned one"


def chain_breaks(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(name, reason) of links that don't hold, with the first reason that applies. links: name, payload (JSON text), recorded (its recorded hash), parent (the hash it is bound to; null for a root). roots: the hashes (root) of pinned roots; None pins none.

    A link is known by its re-derived hash. It is broken by itself if its payload is no JSON or doesn't hash to its record, if it is its own parent, if another link has its hash, if its parent is no link's hash, or if another link has its parent
    (a chain has no forks: neither counts). It is broken by what it hangs on if its ancestors run in a circle, if one of them is broken, or if they end at a root that isn't pinned.
    """
    # Hashes are met twice, by what they are of and by what they are bound to; everything after that goes by a link's number.
    # A parent that isn't written as a hash is no link's; its text is kept only to choose among the parents of equal links.
    told = F.col("parent").cast("string")
    parent = digest(told)
    own = canonical_sha256(F.col("payload"))
    read = links.select("name", F.col("recorded").eqNullSafe(own).alias("kept"), F.unhex(own).alias("own"), parent.alias("parent"), F.when(parent.isNull(), told).alias("other"))
    hashed = settle(read.withColumn("id", F.monotonically_increasing_id()))
    marked = _with_equals(hashed)
    own_reason = F.when(F.col("own").isNull(), NO_JSON).when(~F.col("kept"), CHANGED).when(F.col("selfish"), SELF).when(F.col("twice"), TWICE)
    ends = followed(settle(_bound(marked, roots)))
    # A node whose parent isn't there is flawed by itself and points at a number of its own; what hangs on it ends at the same.
    reason = (
        F.when((F.col("kind") == "MISSING") & (F.col("up") == -1 - F.col("own")), UNKNOWN)
        .when(F.col("fork"), FORK)
        .when(F.col("kind").isNull(), CIRCLE)
        .when(F.col("flawed") | (F.col("kind") == "MISSING"), FLAWED)
        .when(F.col("kind") == "ROOT", F.lit(None) if roots is None else F.lit(ASTRAY))
    )
    by_end = ends.select(F.col("own").alias("_node"), reason.alias("reason")).where("reason is not null")
    judged = marked.select("id", "name", own_reason.alias("reason"))
    hanging = judged.where("reason is null").select("id", "name").join(by_end.hint("merge"), F.col("id") == F.col("_node"))
    return judged.where("reason is not null").select("name", "reason").unionByName(hanging.select("name", "reason"))


def _with_equals(hashed: DataFrame) -> DataFrame:
    """Links with what they share with those of the same hash: twice (there are others), first (whether this one stands for all), above and lost (the parent of all: the least as text; lost if it isn't written as a hash) and selfish (it is their own hash). Equal hashes are looked for by 8 bytes first, and the links with such are compared whole."""
    short = F.xxhash64("own")
    alike = settle(hashed.where("own is not null").select(short.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"))
    shared = hashed.withColumns({"twice": F.lit(False), "first": F.lit(True), "above": F.col("parent"), "lost": F.col("other").isNotNull()})
    if not alike.isEmpty():
        text = F.least(F.lower(F.hex(F.min("parent"))), F.min("other"))
        equal = hashed.where("own is not null").join(alike, short == F.col("_h")).groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_first"), F.min("parent").alias("_parent"), text.alias("_text")).where("n > 1")
        lost = F.coalesce(F.col("_text") != F.lower(F.hex("_parent")), F.col("_text").isNotNull())
        equal = settle(equal.select(F.col("own").alias("_equal"), "_first", "_parent", lost.alias("_lost")))
        met = hashed.join(equal, F.col("own") == F.col("_equal"), "left")
        twice = F.col("_equal").isNotNull()
        pick = lambda there, own: F.when(twice, F.col(there)).otherwise(own)
        shared = settle(met.select(*hashed.columns, twice.alias("twice"), pick("_first", F.col("id")).eqNullSafe(F.col("id")).alias("first"), pick("_parent", F.col("parent")).alias("above"), pick("_lost", F.col("other").isNotNull()).alias("lost")))
    selfish = ~F.col("lost") & F.coalesce(F.col("above") == F.col("own"), F.lit(False))
    return shared.withColumns({"selfish": selfish, "above": F.when(~selfish & ~F.col("lost"), F.col("above"))})


def _bound(marked: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The nodes as rows for followed(), by number, each pointing to its parent's. kind: PINNED or ROOT (up has no parent) or MISSING (up is -1 - the number of the node whose parent isn't there)."""
    nodes = marked.where("own is not null and first")
    top = F.col("above").isNull() & ~F.col("lost")
    bad = ~F.col("kept") | F.col("selfish") | F.col("twice")
    # What there is to one hash: the node that has it, the links that are bound to it, and whether it is pinned.
    said = nodes.select(F.col("own").alias("hash"), F.col("id").alias("node"), top.alias("top"), bad.alias("bad"))
    said = said.unionByName(marked.where("parent is not null").select(F.col("parent").alias("hash"), F.lit(1).alias("child")), allowMissingColumns=True)
    pins = marked.limit(0).select(F.col("own").alias("hash")) if roots is None else roots.select(digest(F.col("root")).alias("hash"))
    said = said.unionByName(pins.where("hash is not null").withColumn("pinned", F.lit(True)), allowMissingColumns=True)
    by_hash = said.groupBy("hash").agg(F.max("node").alias("node"), F.bool_or("top").alias("top"), F.bool_or("bad").alias("bad"), F.count("child").alias("children"), F.bool_or("pinned").alias("pinned")).where("node is not null")
    # A node without a parent looks itself up and is its own end; one whose parent isn't written as a hash meets nothing.
    looks = nodes.select(F.col("id").alias("own"), F.when(top, F.col("own")).otherwise(F.col("above")).alias("at"), (~top).alias("below"))
    met = looks.join(by_hash.hint("merge"), F.col("at") == F.col("hash"), "left")
    kind = F.when(F.col("node").isNull(), "MISSING").when(F.col("top") & F.col("pinned"), "PINNED").when(F.col("top"), "ROOT")
    of_parent = lambda c: F.coalesce(F.col("below") & c, F.lit(False))
    return met.select("own", F.coalesce("node", -1 - F.col("own")).alias("up"), kind.alias("kind"), of_parent(F.col("bad")).alias("flawed"), of_parent(F.col("children") > 1).alias("fork"))


def requirements(document: Column, required: list[str]) -> Column:
    """What a document's bounds lack: names that are missing or not asked for, and bounds without a value_basis; an empty array if nothing."""
    bounds = F.from_json(F.get_json_object(document, "$.bounds"), "map<string,string>")
    names = F.coalesce(F.map_keys(bounds), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, required))
    tell = lambda items, what: F.transform(items, lambda n: F.concat(F.lit(what), n))
    bare = F.filter(names, lambda n: F.coalesce(F.get_json_object(F.element_at(bounds, n), "$.value_basis"), F.lit("")) == "")
    return F.array_sort(F.concat(tell(F.array_except(wanted, names), "missing "), tell(F.array_except(names, wanted), "unexpected "), tell(bare, "no value_basis in ")))


def declarations(document: Column, questions: list[str], outcomes: list[str]) -> Column:
    """What a document's declarations lack: its questions' ids must be the given ones in their order, its outcomes the given ones in any; an empty array if nothing, both for a document that is none."""
    ids = F.transform(F.from_json(F.get_json_object(document, "$.questions"), "array<struct<id:string>>"), lambda q: q["id"])
    named = F.from_json(F.get_json_object(document, "$.outcomes"), "array<string>")
    given = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    bad = F.array(
        F.when(~F.coalesce(same_members(named, given(outcomes)), F.lit(False)), "outcomes are not the declared ones"),
        F.when(~F.coalesce(same_order(ids, given(questions)), F.lit(False)), "questions are not the declared ones in their order"),
    )
    return F.filter(bad, lambda x: x.isNotNull())


def unbound(documents: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, binds, pinned, reason) of bindings that don't hold. documents: name, text (JSON with an object bindings from names to hashes); pins: name, sha256, each name once.

    A binding must name a pin and have its hash. A pin that a document lacks is no fault of it; documents without bindings have none.
    """
    bindings = F.from_json(F.get_json_object("text", "$.bindings"), "map<string,string>")
    each = documents.select("name", F.explode(bindings).alias("pinned", "binds"))
    met = each.join(pins.select(F.col("name").alias("pinned"), F.col("sha256").alias("pin")), "pinned", "left")
    reason = F.when(F.col("pin").isNull(), "nothing is pinned under this name").when(~F.col("pin").eqNullSafe(F.col("binds")), "bound hash differs from the pinned one")
    return met.withColumn("reason", reason).where("reason is not null").select("name", "binds", "pinned", "reason")


def seal(spark, payload: dict, path: str, write: bool = False) -> dict:
    """The seal record of a payload; with write=True also written to path, which must not exist: a seal is never overwritten. The default writes nothing."""
    # The keys and the status of a seal record.
    record = {"seal_payload": payload, "seal_hash": sha256_of(payload)}
    if write:
        record |= {"sealed_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "status": "SEALED"}
        spark.createDataFrame([(json.dumps(record, indent=2),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return record
