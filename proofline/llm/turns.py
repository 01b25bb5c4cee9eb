"""Conversation structure repair: the cheapest edits after which a conversation's roles read (s?(ua)+)?, an optional system turn and then pairs of user and assistant.

Rows are sorted by conversation and turn into ranges, and each range is cut into segments of SEGMENT rows, so that a conversation of any length is a number of segments and no task holds more than it sorts. What a role sequence
may go on with is one of four states. For segments of like length at once, a turn a step, the costs to the end from every state are computed backwards and kept; forward from there the edits are traced, the first letter in
ASCII order among the cheapest at each step. A segment that isn't its conversation's last shows its costs to each state it may end in (a matrix of 4 by 4); products of those give what follows each segment costs, and the edits are traced
from each state it may begin in. One row a segment decides which of the four is taken.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows of a segment at most; a power of two.
SEGMENT = 4096
#: Costs of edits, and of a truncated turn that isn't deleted. A duplicate or blank turn must be deleted.
DELETE, RELABEL, INSERT, TRUNCATED = 2, 1, 5, 5
#: Numbers of costs that are kept at a time.
COSTS_AT_ONCE = 1 << 21
#: States: nothing yet, after system, after user, after assistant. A row's kind is the state that its role leads to, or 0.
START, SYSTEM, USER, ASSISTANT = range(4)
MUST_DELETE, CUT_SHORT = 4, 8
_NEVER = np.int32(1 << 29)
#: Where an inserted turn leads from each state, and which kinds may be kept in it.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_MAY = np.zeros((4, 4), bool)
_MAY[START, SYSTEM] = _MAY[START, USER] = _MAY[SYSTEM, USER] = _MAY[USER, ASSISTANT] = _MAY[ASSISTANT, USER] = True
_ROLE = [None, "system", "user", "assistant"]
_FINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int32)  # what a conversation costs yet that ends in a state


def _row_costs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keep, relabel) by (state, row) for rows of these codes; deletion has one cost."""
    kind, must, late = code & 3, (code & MUST_DELETE) > 0, np.where(code & CUT_SHORT, TRUNCATED, 0).astype(np.int32)
    relabel = np.where(must, _NEVER, RELABEL + late).astype(np.int32)
    return np.where(_MAY[:, kind] & ~must, late, _NEVER).astype(np.int32), relabel


def costs_to_go(codes: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs by (turn, state, segment), turns 0 to the longest: the cheapest from a state before a turn to the end. codes: by (turn, segment), padded; end: costs by (state, segment) after the last row, insertions there included."""
    steps, n = codes.shape
    out = np.empty((steps + 1, 4, n), np.int32)
    out[steps] = end
    for t in range(steps - 1, -1, -1):
        after, keep_relabel = out[t + 1], _row_costs(codes[t])
        best = after + DELETE
        to = after[codes[t] & 3, np.arange(n)]
        best = np.minimum(best, keep_relabel[0] + to)
        best = np.minimum(best, keep_relabel[1] + after[_NEXT])
        by_insertion = best[_NEXT] + INSERT
        best = np.minimum(best, by_insertion)
        best = np.minimum(best, best[_NEXT] + INSERT)
        out[t] = np.where(t < sizes, np.minimum(best, _NEVER), end)
    return out


def trace(codes: np.ndarray, sizes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, turn, letter, state after) of the cheapest edits from these states, ASCII-least in order D, I, K, R, and the states in the end. Where last, what is still to be inserted follows after all rows; its turn is -1, as that of all insertions."""
    steps, n = codes.shape
    q, every = state.copy(), np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]] = []
    for t in range(steps):
        waits = every[(t < sizes) & (costs[t, q, every] < _NEVER)]
        while len(waits):
            own, after = q[waits], costs[t + 1]
            here = costs[t, own, waits]
            keep = _row_costs(codes[t, waits])[0][own, np.arange(len(waits))]
            deleted = after[own, waits] + DELETE == here
            inserted = ~deleted & (costs[t, _NEXT[own], waits] + INSERT == here)
            kept = ~deleted & ~inserted & (keep + after[codes[t, waits] & 3, waits] == here)
            to = np.where(deleted, own, np.where(kept, codes[t, waits] & 3, _NEXT[own]))
            letter = np.where(deleted, b"D", np.where(inserted, b"I", np.where(kept, b"K", b"R")))
            q[waits] = to
            found.append((waits, np.where(inserted, -1, t), letter, to))
            waits = waits[inserted]
    open_ = every[last & ((q == USER) | (q == SYSTEM)) & (_FINAL[q] < _NEVER)]
    while len(open_):
        q[open_] = _NEXT[q[open_]]
        found.append((open_, np.full(len(open_), -1), np.full(len(open_), b"I"), q[open_]))
        open_ = open_[q[open_] == USER]
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "S1"), np.zeros(0, np.int64), q)
    segment, turn, letter, to = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(segment, kind="stable")
    return segment[order], turn[order], letter[order], to[order], q


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for c in codes])
    out = np.zeros((int(sizes.max()), len(codes)), np.uint8)
    for i, c in enumerate(codes):
        out[: len(c), i] = c
    return out, sizes


def _buckets(sizes: list[int], width: int) -> Iterator[list[int]]:
    """Indexes of segments of like length, few enough that their costs fit in COSTS_AT_ONCE."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        by.setdefault(max(1, n - 1).bit_length(), []).append(i)
    for bits, own in sorted(by.items()):
        most = max(1, COSTS_AT_ONCE // (4 * width * ((1 << bits) + 1)))
        for lo in range(0, len(own), most):
            yield own[lo : lo + most]


def segment_matrices(codes: list[np.ndarray]) -> np.ndarray:
    """The cheapest from each state before a segment to each state after it: an array (segment, from, to)."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for own in _buckets([len(c) for c in codes], 4):
        padded, sizes = _padded([codes[i] for i in own])
        ends = np.where(np.eye(4, dtype=bool), 0, _NEVER).astype(np.int32)  # (to, state)
        for to in range(4):
            costs = costs_to_go(padded, sizes, np.repeat(ends[to][:, None], len(own), 1))
            out[own, :, to] = costs[0].T
    return out


def suffix_costs(matrices: np.ndarray) -> np.ndarray:
    """What follows each segment of one conversation, in order, costs from each state over those of the cheapest: rows of 4."""
    out = np.empty((len(matrices), 4), np.int64)
    now = _FINAL.astype(np.int64)
    for i in range(len(matrices) - 1, -1, -1):
        now -= now.min()
        out[i] = now
        now = np.minimum((matrices[i] + now[None, :]).min(1), int(_NEVER))
    return out


_EDIT = "edits array<struct<uid:long,letter:string,role:string>>"


def _meta(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(uids, codes) of each segment of a batch with a column rows."""
    rows = batch.column("rows")
    flat, offsets = rows.flatten(), np.r_[0, np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))]
    uid, code = flat.field("uid").to_numpy(zero_copy_only=False), flat.field("code").to_numpy(zero_copy_only=False).astype(np.uint8)
    return [uid[a:b] for a, b in zip(offsets, offsets[1:])], [code[a:b] for a, b in zip(offsets, offsets[1:])]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            m = segment_matrices(_meta(b)[1]).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), pa.array(list(m), pa.list_(pa.int64()))], ["conv", "seg", "m"])


def _after(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("seg")
    costs = suffix_costs(np.array(frame["m"].tolist(), np.int64).reshape(-1, 4, 4))
    return pd.DataFrame({"conv": frame["conv"], "seg": frame["seg"], "after": list(costs)})


def _entries(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("seg")
    state, chosen = START, []
    for exits in frame["exits"].tolist():
        chosen.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv": frame["conv"], "seg": frame["seg"], "entry": chosen})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, seg, entry, exit, edits): one for a segment that is a whole conversation, else one for each state it may begin in. The column after is null in the first case."""
    roles = np.array(_ROLE, object)
    for b in batches:
        uids, codes = _meta(b)
        after = b.column("after").to_pylist()
        for own in _buckets([len(c) for c in codes], 1):
            padded, sizes = _padded([codes[i] for i in own])
            end = np.array([_FINAL if after[i] is None else after[i] for i in own], np.int64).T.astype(np.int32)
            last = b.column("is_last").to_numpy(zero_copy_only=False)[own]
            costs = costs_to_go(padded, sizes, end)
            for entry in range(4):
                needed = np.array([after[i] is not None or entry == START for i in own])
                if not needed.any():
                    continue
                seg, turn, letter, to, exits = trace(padded, sizes, costs, np.full(len(own), entry), last)
                of = np.searchsorted(seg, np.arange(len(own) + 1))
                flat_uid = np.array([uids[own[s]][t] if t >= 0 else -1 for s, t in zip(seg.tolist(), turn.tolist())], np.int64)
                role = np.where(letter == b"I", roles[to], np.where(letter == b"R", roles[to], None))
                edits = pa.StructArray.from_arrays([pa.array(flat_uid, mask=flat_uid < 0), pa.array(letter.astype(str).tolist(), pa.string()), pa.array(role.tolist(), pa.string())], ["uid", "letter", "role"])
                lists = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), edits)
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv").take(at), b.column("seg").take(at), pa.array([entry] * len(own), pa.int32()), pa.array(exits.astype(np.int32)), lists], ["conv", "seg", "entry", "exit", "edits"]
                ).filter(pa.array(needed))


def turn_key(role: Column, text: Column) -> Column:
    """A digest of role and text: rows of one digest count as the same."""
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def conversation_key(conv_id: Column) -> Column:
    """A string for each id; null ids are one conversation."""
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def prepared(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, conv_id, turn, role, text, uid, key), written once, so that uid names a row wherever it is read. Null roles and texts are one space."""
    space = F.lit(" ")
    each = turns.select(conversation_key(F.col(conv)).alias("conv"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    return settle(each.withColumns({"uid": F.monotonically_increasing_id(), "key": turn_key(F.col("role"), F.col("text"))}))


def ordered(each: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, seg, place, uid, turn, initial, fault): the rows of prepared() in ranges of (conv, turn, key), nulls first, cut into segments of so many rows; places grow along them. Written once.

    fault is the row's first of blank, duplicate (role and text stand earlier) and truncated (the last character but white space isn't one of .!?), or null.
    """
    where = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"), F.col("uid").alias("uid"))
    first = each.groupBy("conv", "key").agg(F.min(where).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    own = each.select(
        "conv", "key", "turn", "uid", F.substring("role", 1, 1).alias("initial"), where.alias("_where"),
        F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("said"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"),
    )
    fault = F.when(~F.col("said"), "blank").when(F.col("_where") != F.col("_first"), "duplicate").when(~F.col("ended"), "truncated")
    marked = own.join(first, ["conv", "key"], "left").select("conv", "turn", "key", "uid", "initial", fault.alias("fault"))
    along = ["conv", F.col("turn").asc_nulls_first(), "key", "uid"]
    ranges = marked.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("place", F.monotonically_increasing_id())
    return settle(ranges.select("conv", F.expr(f"place div {segment}").alias("seg"), "place", "uid", "turn", "initial", "fault"))


def edits_of(rows: DataFrame) -> DataFrame:
    """(conv, seg, edits): the cheapest edits of the rows of ordered(), segment by segment."""
    kind = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(0)
    code = kind + F.when(F.col("fault").isin("blank", "duplicate"), MUST_DELETE).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(0)
    entry = F.struct("place", "uid", code.cast("int").alias("code"))
    segments = rows.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    parts = rows.select("conv", "seg").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("seg").alias("is_last")).where("n > 1").drop("n")
    # Conversations of one segment need no more; the others' segments are few, one for each boundary between segments and two more.
    whole = segments.join(parts, "conv", "left_anti").withColumns({"is_last": F.lit(True), "after": F.lit(None).cast("array<long>")})
    many = settle(segments.join(parts, "conv").withColumn("is_last", F.col("seg") == F.col("is_last")))
    matrices = many.select("conv", "seg", "rows").mapInArrow(_matrices, "conv string, seg long, m array<long>")
    after = matrices.groupBy("conv").applyInPandas(_after, "conv string, seg long, after array<long>")
    result = f"conv string, seg long, entry int, exit int, {_EDIT}"
    columns = ["conv", "seg", "rows", "is_last", "after"]
    traced = settle(many.join(after, ["conv", "seg"]).select(columns).mapInArrow(_traced, result))
    exits = traced.groupBy("conv", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "exit"))), lambda x: x["exit"]).alias("exits"))
    entries = exits.groupBy("conv").applyInPandas(_entries, "conv string, seg long, entry int")
    chosen = traced.join(entries, ["conv", "seg", "entry"], "left_semi")
    return whole.select(columns).mapInArrow(_traced, result).unionByName(chosen).select("conv", "seg", "edits")


def repaired(each: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, seg, at, letter, uid, role, text): a row for each edit; role and text are those of the repaired turn, null where it is deleted."""
    steps = edits.select("conv", "seg", F.posexplode("edits").alias("at", "e")).select("conv", "seg", "at", "e.letter", "e.uid", F.col("e.role").alias("_new"))
    texts = each.select("uid", F.col("role").alias("_role"), F.col("text").alias("_text"))
    with_text = steps.where("letter in ('K', 'R')").join(texts, "uid").select("conv", "seg", "at", "letter", "uid", F.coalesce("_new", "_role").alias("role"), F.col("_text").alias("text"))
    others = steps.where("letter in ('D', 'I')").select("conv", "seg", "at", "letter", "uid", F.col("_new").alias("role"), F.when(F.col("letter") == "I", F.lit("")).alias("text"))
    return with_text.unionByName(others)


def repair_conversations(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, at, letter, turn, role, text): a row for each of the cheapest edits of every conversation of turns (conv_id, turn, role, text), in order of (seg, at): K keeps a turn, R gives it another role, D deletes it (role and text null), I inserts one of empty text.

    Turns are in order of turn, nulls first; of one turn, rows are in order of a digest of role and text. Null ids are one conversation; null roles and texts are one space. Blank turns and those whose role and text stand earlier are deleted; a
    truncated turn costs more if it stays. Other columns aren't returned. An empty table gives none.
    """
    each = prepared(turns)
    made = repaired(each, edits_of(ordered(each, segment)))
    turn = each.select("uid", "turn")
    ids = each.groupBy("conv").agg(F.max("conv_id").alias("conv_id"))
    return made.join(turn, "uid", "left").join(ids, "conv").select("conv_id", "seg", "at", "letter", "turn", "role", "text")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) after faults chosen by CRC-32 of conversation and turn: 1 of 20 goes, 1 loses its text, 1 its marks .!?, 1 is there twice, 1 is a user's. Nulls count as one space."""
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    text = F.when(F.col("_draw") == 1, F.lit("")).when(F.col("_draw") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_draw") == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), space))
    left = turns.select("conv_id", "turn", "role", "text", draw.alias("_draw")).where("_draw <> 0")
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) of rows (conv, line) in order, a conversation after the other; what is held is one hash state."""
    conv, state = None, None
    for b in batches:
        names, done = [], []
        for c, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist()):
            if c != conv:
                if state is not None:
                    names.append(conv)
                    done.append(state.hexdigest())
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.string())], ["conv", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([state.hexdigest()], pa.string())], ["conv", "repaired_sha256"])


def conversation_digests(repairs: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the hash of each repaired conversation's role:text, joined by newlines. Such a hash is made in order, so a conversation's lines pass through one task, which holds none of them."""
    lines = repairs.where("letter <> 'D'").select("conv", "seg", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "seg", "at").select("conv", "line").mapInArrow(_digests, "conv string, repaired_sha256 string")


def op11(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The digest of a repair of damaged turns that op11_repair_turns returns: a row for each conv_id of turns, null included."""
    each = prepared(damaged(turns))
    rows = ordered(each, segment)
    edits = settle(edits_of(rows))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # Two rows that meet: in a segment, and at the boundary of two of one conversation.
    ends = lambda f: f(F.struct("place", "initial"))["initial"]
    pairs = rows.groupBy("conv", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "initial"))), lambda x: x["initial"]).alias("own"), ends(F.min).alias("head"), ends(F.max).alias("tail"))
    meets = F.zip_with(F.slice("own", 1, F.size("own") - 1), F.slice("own", 2, F.size("own") - 1), lambda a, b: F.concat(a, b))
    legal = ("su", "ua", "au")
    inside = pairs.select("conv", "seg", "head", "tail", F.size(F.filter(meets, lambda x: ~x.isin(*legal))).cast("long").alias("illegal"))
    along = Window.partitionBy("conv").orderBy("seg")
    before = F.lag("tail").over(along)
    illegal = inside.withColumn("edge", F.when(before.isNotNull() & ~F.concat(before, F.col("head")).isin(*legal), 1).otherwise(0)).groupBy("conv").agg(F.sum(F.col("illegal") + F.col("edge")).alias("illegal"))
    facts = rows.groupBy("conv").agg(*[one(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turn = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("_one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    late = F.transform(F.filter("edits", lambda e: e["letter"].isin("K", "R")), lambda e: e["uid"])
    price = F.aggregate("edits", F.lit(0).cast("long"), lambda n, e: n + F.when(e["letter"] == "D", DELETE).when(e["letter"] == "R", RELABEL).when(e["letter"] == "I", INSERT).otherwise(0))
    stays = edits.select(F.explode(late).alias("uid"), "conv")
    cut_short = stays.join(rows.where("fault = 'truncated'").select("uid"), "uid").groupBy("conv").agg((TRUNCATED * F.count(F.lit(1))).alias("_late"))
    letters = F.concat_ws("", F.transform("edits", lambda e: e["letter"]))
    audits = edits.groupBy("conv").agg(F.sum(price).alias("_cost"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seg", letters.alias("a")))), lambda x: x["a"])).alias("audit"))
    out = turns.select("conv_id", conversation_key(F.col("conv_id")).alias("conv")).groupBy("conv").agg(F.max("conv_id").alias("conv_id"))
    for part in (turn, facts, illegal, audits, cut_short, conversation_digests(repaired(each, edits))):
        out = out.join(part, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    cost = (F.coalesce("_cost", F.lit(0)) + F.coalesce("_late", F.lit(0))).cast("long").alias("cost")
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal")), cost, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql_min(*cases: str) -> str:
    return f"list_min([{', '.join(cases)}])"


def _sql_step(state: str, letter: str, cost: str) -> str:
    return f"{{'c': struct_extract({state}, 'c') + {cost}, 'a': struct_extract({state}, 'a') || '{letter}'}}"


def _sql_inserted(*states: str) -> str:
    """The four states with what insertions add."""
    s0, s1, s2, s3 = states
    at2 = _sql_min(s2, *(_sql_step(s, "I", str(INSERT)) for s in (s0, s1, s3)))
    return f"{s0} AS r0, {s1} AS r1, {at2} AS r2, {_sql_min(s3, _sql_step('r2', 'I', str(INSERT)))} AS r3"


def _sql_states() -> str:
    """The four states after a row with kind, must and late, from r0 to r3."""
    out = []
    for to, froms in ((START, ()), (SYSTEM, (0,)), (USER, (0, 1, 3)), (ASSISTANT, (2,))):
        kept = [_sql_step(f"r{f}", "K", f"CASE WHEN must OR kind <> {to} THEN 1000000 ELSE late END") for f in froms]
        relabelled = [_sql_step(f"r{f}", "R", f"CASE WHEN must THEN 1000000 ELSE {RELABEL} + late END") for f in froms if to != SYSTEM]
        out.append(f"{_sql_min(_sql_step(f'r{to}', 'D', str(DELETE)), *kept, *relabelled)} AS s{to}")
    return ", ".join(out)


#: The same by a search forward, a row a step: what is cheapest up to each state, and of that the least in ASCII. CRC-32 is reduced over the bytes.
OP11_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
),
drawn AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS draw
  FROM conversations, crc
),
damaged AS (
  SELECT conv, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, key, copy) AS pos FROM (SELECT *, substr(role, 1, 1) AS initial, sha256(length(role) || ':' || role || text) AS key FROM damaged)
),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, key ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv ORDER BY pos) AS before
  FROM placed
),
coded AS (
  SELECT *, CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS late FROM judged
),
walked AS (
  SELECT conv, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000::BIGINT, 'a': ''}} AS s1, {{'c': 1000000::BIGINT, 'a': ''}} AS s2, {{'c': 1000000::BIGINT, 'a': ''}} AS s3 FROM (SELECT DISTINCT conv FROM coded)
  UNION ALL
  SELECT conv, pos, {_sql_states()} FROM (SELECT w.conv, c.pos, kind, must, late, {_sql_inserted("s0", "s1", "s2", "s3")} FROM walked w JOIN coded c ON w.conv = c.conv AND c.pos = w.pos + 1)
),
ended AS (
  SELECT conv, {_sql_min("r0", "r3")} AS best FROM (SELECT conv, {_sql_inserted("s0", "s1", "s2", "s3")} FROM walked w WHERE pos = (SELECT max(pos) FROM coded c WHERE c.conv = w.conv))
),
steps AS (
  SELECT conv, k, letter, count(*) FILTER (letter <> 'I') OVER along AS pos, count(*) FILTER (letter <> 'D') OVER along AS nth
  FROM (SELECT conv, unnest(range(1, length(best.a) + 1)) AS k, unnest(string_split(best.a, '')) AS letter FROM ended WHERE best.a <> '') WINDOW along AS (PARTITION BY conv ORDER BY k)
),
turned AS (
  SELECT s.conv, s.k, s.letter, s.nth, c.role, c.initial, coalesce(c.text, '') AS text, max(CASE WHEN s.letter = 'K' AND c.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv) AS opened
  FROM steps s LEFT JOIN coded c ON s.conv = c.conv AND s.pos = c.pos AND s.letter <> 'I' WHERE s.letter <> 'D'
),
told AS (SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS said FROM turned GROUP BY conv),
facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM drawn) o LEFT JOIN facts f ON o.conv = f.conv LEFT JOIN ended e ON o.conv = e.conv LEFT JOIN told t ON o.conv = t.conv
"""
