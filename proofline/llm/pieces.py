"""SentencePiece encoding and decoding by a streaming Viterbi search over a model's pieces.

The search runs over the characters of a normalised text (a space in front, spaces written as U+2581). At each boundary it keeps the best
score of a path to it and the piece by which that path arrives, for no more boundaries than the longest piece has characters, plus those whose ids
aren't committed yet. Whenever the backpointers of all surviving boundaries (those that a piece still to come can start from) lead
back to one boundary, the ids before it are final and are committed, so that memory follows the longest ambiguous stretch, not
the text. Where they don't meet, as in a run of one character, they are looked for again only when twice as much waits, so that time stays linear.

What follows a committed boundary doesn't hang on what came before it. So a text is handled in segments that are guessed from its white space, many at once, a character
a step, each with the character behind it: if the search commits the segment's end when it has seen that character, the ids hold wherever the same segment and character
stand behind a committed boundary, and are remembered. A text in which one guess isn't committed is searched as a whole.

Scores are the model's own if it is a unigram model. A BPE model stores ranks of merges instead; a piece of rank r then scores
-ln(r + 2), as Zipf's law has it for a list in order of frequency. Characters without a piece fall back to their bytes, as does a literal U+2581,
so that decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cuts

MARK = "▁"
#: A worker remembers the ids of so many segments, and of as many older ones. Longer segments are searched each time.
CACHE, CACHED_CHARS = 150_000, 64
#: Boundaries that a search in lanes holds, those of the longest piece and of what isn't committed; where that doesn't do, the segment is searched by itself. Fewer segments than LANES are, too; AT_ONCE go together.
RING, LANES, AT_ONCE = 128, 16, 1 << 13
#: A task encodes so many characters at a time, and gives out rows once it has encoded as many.
BATCH_CHARS = 1 << 20
#: What a fallback to bytes costs less than the worst piece.
FALLBACK_COST = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) for each id, and whether the model is a BPE model, from a SentencePiece model file."""
    pieces, bpe = [], False
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
    return pieces, bpe


class Pieces:
    """A vocabulary with scores. pieces: (piece, score, type) by id."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool = False):
        self.scores = [self.zipf(s) if bpe and kind == NORMAL else s for _, s, kind in pieces]
        usable = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        self.ids = {p: (i, self.scores[i]) for p, i in usable}
        self.fallback = min((s for _, s in self.ids.values()), default=0.0) - FALLBACK_COST
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [None] * 256
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.raw: list[bytes] = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            else:
                self.raw.append(b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode())
        # Where texts are cut into segments to begin with: before spaces, and around characters that no longer piece has.
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = [c for c in "\n\t\r" if c not in inside]
        self.spans = re.compile(f"[{re.escape(''.join(self.alone))}]|{MARK}*[^{MARK}{re.escape(''.join(self.alone))}]+|{MARK}+" if self.alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        #: (id, score) of pieces, and () for what a piece begins with.
        self.table: dict[str, tuple] = {p[:n]: () for p in self.ids for n in range(1, len(p))} | self.ids

    @staticmethod
    def zipf(score: float) -> float:
        return -math.log(2 + (-score if -1e8 < score <= 0 else 1e6))

    @classmethod
    def load(cls, path: str) -> Pieces:
        return cls(*read_model(path))

    def relax(self, text: str, start: int, stop: int, best: list, back: list, last: list) -> None:
        """Tries every piece that begins at a boundary from start on and before stop."""
        get, fallback, end = self.table.get, self.fallback, len(text)
        for i in range(start, stop):
            here, j = best[i], i + 1
            found = get(text[i:j])
            if not found and (score := here + fallback) > best[j]:
                best[j], back[j], last[j] = score, i, None
            while found is not None:
                if found and (score := here + found[1]) > best[j]:
                    best[j], back[j], last[j] = score, i, found[0]
                j += 1
                found = get(text[i:j]) if j <= end else None

    def follow(self, text: str, at: int, back: list, last: list) -> list[int]:
        """The ids on the way back from boundary at, in order."""
        out: list[int] = []
        while at:
            i = back[at]
            if last[at] is None:
                out += self.unseen(text[i:at])[::-1]
            else:
                out.append(last[at])
            at = i
        out.reverse()
        return out

    def unseen(self, char: str) -> list[int]:
        """The ids of a character that has no piece."""
        own = [self.bytes[b] for b in char.encode()]
        return [self.unknown] if None in own else own


class StreamingViterbi:
    """Feed normalised text in parts of any size; each call returns the ids that have become final. finish() returns the rest.

    Scores are those of the path from the last committed boundary, so that they don't grow with the text.
    """

    BLOCK = 4096

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # from the last committed boundary
        self.best: list[float] = [0.0]  # best score by boundary
        self.back: list[int] = [0]  # where the best path's last piece begins
        self.last: list[int | None] = [None]  # its id; None: a fallback to bytes
        self.tried = 0  # the first boundary from which no piece has been tried
        self.look = self.BLOCK  # how many boundaries may wait before a meeting is looked for

    def feed(self, part: str) -> list[int]:
        self.text += part
        return self._advance(self.pieces.longest)

    def finish(self) -> list[int]:
        return self._advance(0) + self._commit(len(self.text))

    def _advance(self, ahead: int) -> list[int]:
        """Tries pieces from all boundaries but the last ahead ones, where a piece might not fit in yet, and commits whenever what waits has doubled, a block at least: looking back costs what waits, and so no more than the text in all."""
        out = []
        while self.tried < len(self.text) - ahead:
            self._try_block(min(self.tried + self.BLOCK, len(self.text) - ahead))
            if self.tried >= self.look:
                out += self._commit(self._meeting())
                self.look = max(self.BLOCK, 2 * self.tried)
        return out

    def _try_block(self, stop: int) -> None:
        longest = self.pieces.longest
        missing = min(len(self.text), stop + longest) + 1 - len(self.best)
        if missing > 0:
            self.best += [-math.inf] * missing
            self.back += [0] * missing
            self.last += [None] * missing
        self.pieces.relax(self.text, self.tried, stop, self.best, self.back, self.last)
        self.tried = stop

    def _meeting(self) -> int:
        """The last boundary through which the paths to all surviving boundaries lead: those reached from self.tried on."""
        order = [-j for j in range(len(self.best) - 1, self.tried - 1, -1) if self.best[j] > -math.inf]
        alive = set(order)  # the furthest one first
        while len(order) > 1:
            to = -self.back[-order[0]]
            if to in alive:
                heapq.heappop(order)
            else:
                alive.add(to)
                heapq.heapreplace(order, to)
        return -order[0]

    def _commit(self, at: int) -> list[int]:
        """Gives out the ids before boundary at, and forgets what they stand for."""
        out = self.pieces.follow(self.text, at, self.back, self.last)
        base = self.best[at]
        self.text, self.best = self.text[at:], [s - base for s in self.best[at:]]
        self.back, self.last = [max(0, b - at) for b in self.back[at:]], self.last[at:]
        self.tried = max(0, self.tried - at)
        return out


class Lanes:
    """The same search over many segments at once, a character a step, with rings of RING boundaries.

    Substrings are looked up by 64-bit hashes, length by length, for the segments in which a piece can still go on. A step at which no piece goes on or ends but
    from the boundary before it shows that all paths lead through that boundary: the ids before it are committed. Segments with a character that has no piece are left out.
    """

    FACTOR = np.uint64(0x9E3779B97F4A7C15)
    NONE = np.uint32(0xFFFFFFFF)

    def __init__(self, pieces: Pieces):
        self.tables: list[tuple[np.ndarray, ...]] = []  # by length: hashes of pieces and of what pieces begin with; ids, scores (-inf: no piece), whether longer pieces begin so
        self.held = 0  # the most boundaries that weren't committed
        by_length: dict[int, list[str]] = {}
        for p in pieces.table:
            by_length.setdefault(len(p), []).append(p)
        longer = {p[:-1] for p in pieces.table}
        for n in range(1, pieces.longest + 1):
            own = by_length.get(n, [])
            hashes = np.zeros(len(own), np.uint64)
            for column in np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64).T:
                hashes = hashes * self.FACTOR + column
            order = np.argsort(hashes)
            if (np.diff(hashes[order]) == 0).any():
                raise ValueError("two pieces have one hash")
            found = [pieces.table[p] or (0, -math.inf) for p in own] + [(0, -math.inf)]
            order = np.append(order, len(own))
            self.tables.append((np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))[order], np.array([i for i, _ in found], np.uint32)[order], np.array([x for _, x in found])[order], np.array([p in longer for p in own] + [False])[order]))

    def __call__(self, segments: list[str]) -> list[bytes | None]:
        """The ids of each segment but its last character, which is only looked at; None where a character has no piece, or the end before the last character isn't committed."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        sizes = np.array([len(segments[i]) for i in order])
        codes = np.frombuffer("".join([segments[i] for i in order]).encode("utf-32-le"), "<u4").astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        lanes, steps = len(order), int(sizes[0])
        best, back, last = np.full((RING, lanes), -np.inf), np.zeros((RING, lanes), np.int16), np.zeros((RING, lanes), np.uint32)
        best[0] = 0.0
        done, good = np.zeros(lanes, np.int64), np.ones(lanes, bool)  # the last committed boundary; False: left out
        out = np.full((lanes, steps), self.NONE)  # by boundary less 1: the id of the piece that ends there on the committed path
        alive: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(lanes), np.zeros(lanes, np.uint64))]  # by length: lanes whose last characters begin a longer piece, and their hashes
        for j in range(1, steps + 1):
            on = int(np.searchsorted(-sizes, -j, side="right"))  # lanes are in order of size
            code, now = codes[starts[:on] + (j - 1)], best[j % RING]
            now[:] = -np.inf
            crossed, going = np.zeros(on, bool), [(np.arange(on), np.zeros(on, np.uint64))]
            # The longer of two pieces that lead to one score wins, as where it is tried first.
            for k in range(len(alive), 0, -1):
                lane, hashed = alive[k - 1]
                if len(lane) and lane[-1] >= on:
                    cut = np.searchsorted(lane, on)
                    lane, hashed = lane[:cut], hashed[:cut]
                hashed = hashed * self.FACTOR + code[lane]
                keys, ids, scores, longer = self.tables[k - 1]
                at = np.searchsorted(keys, hashed)
                there = np.flatnonzero(keys[at] == hashed)
                lane, hashed, at = lane[there], hashed[there], at[there]
                if k > 1:
                    crossed[lane] = True
                else:
                    seen = np.zeros(on, bool)
                    seen[lane] = True
                    # The character looked at last needs no piece.
                    good[:on] &= seen | (sizes[:on] == j)
                total = best[(j - k) % RING, lane] + scores[at]
                better = np.flatnonzero(total > now[lane])
                to = lane[better]
                now[to], back[j % RING, to], last[j % RING, to] = total[better], k, ids[at[better]]
                more = np.flatnonzero(longer[at])
                going.insert(1, (lane[more], hashed[more]))
            alive = going[: len(self.tables)]
            if j == 1:
                continue
            # All paths to what is left lead through boundary j - 1: the ids up to it are final.
            met = np.flatnonzero(~crossed & good[:on])
            place, goal = np.full(len(met), j - 1), done[met]
            while len(met):
                out[met, place - 1] = last[place % RING, met]
                place = place - back[place % RING, met]
                more = place > goal
                done[met[~more]] = j - 1
                met, place, goal = met[more], place[more], goal[more]
            waits = j - done[:on]
            self.held = max(self.held, int(waits[good[:on]].max(initial=0)))
            good[:on] &= waits < RING - len(self.tables)
        good &= done == sizes - 1
        kept = out != self.NONE
        ids, ends = out[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)).tolist()
        found: list[bytes | None] = [None] * lanes
        for place, (i, lo, hi, whole) in enumerate(zip(order, [0, *ends], ends, good.tolist())):
            if whole:
                found[i] = ids[4 * lo : 4 * hi]
        return found


class Codec:
    """Encodes and decodes texts, remembering the ids of distinct segments."""

    #: Stands for ids where the search didn't commit a segment's end.
    OPEN = b"?"

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lanes = Lanes(pieces)
        self.memo = Memo(self._search_all, CACHE, CACHED_CHARS + 1)

    def _whole(self, text: str) -> bytes:
        search = StreamingViterbi(self.pieces)
        ids = array("I")
        for at in range(0, len(text), 1 << 16):
            ids.extend(search.feed(text[at : at + (1 << 16)]))
        ids.extend(search.finish())
        return ids.tobytes()

    def _search(self, segment: str) -> bytes:
        """The ids of a segment without its last character, which shows whether a piece goes on over the end."""
        n = len(segment) - 1
        if any(segment[i:] in self.pieces.table for i in range(max(0, n - self.pieces.longest), n)):
            return self.OPEN
        return self._whole(segment[:n])

    def _search_all(self, segments: list[str]) -> list[bytes]:
        """Short segments are searched in lanes if they are many, all others one by one."""
        short = [x for x in segments if len(x) <= CACHED_CHARS + 1]
        found: dict[str, bytes | None] = {}
        for lo in range(0, len(short) if len(short) >= LANES else 0, AT_ONCE):
            some = short[lo : lo + AT_ONCE]
            found.update(zip(some, self.lanes(some)))
        return [self._search(x) if (ids := found.get(x)) is None else ids for x in segments]

    def _literal(self) -> bytes:
        return np.array(self.pieces.unseen(MARK), "<u4").tobytes()

    def _segments(self, text: str) -> list[str | None]:
        """Where a text's ids may be committed, each piece with the character behind it, a space at the end; a literal U+2581, which is no space, stands as None."""
        if not text:
            return []
        out: list[str | None] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(None)
            spans = self.pieces.spans.findall(("" if k else MARK) + part.replace(" ", MARK))
            out += [a + b[0] for a, b in zip(spans, [*spans[1:], MARK])]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts. An empty text has none; any other gets a space in front."""
        segments, ends = [], []
        for t in texts:
            segments += self._segments(t)
            ends.append(len(segments))
        if any(MARK in t for t in texts):
            ids = iter(self.memo([s for s in segments if s is not None]))
            found = [self._literal() if s is None else next(ids) for s in segments]
        else:
            found = self.memo(segments)
        out = [b"".join(found[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        for i, (lo, hi) in enumerate(zip([0, *ends], ends) if self.OPEN in found else ()):
            if self.OPEN in found[lo:hi]:
                parts = ((MARK if not k else "") + part.replace(" ", MARK) for k, part in enumerate(texts[i].split(MARK)))
                out[i] = self._literal().join(self._whole(p) for p in parts)
        return [np.frombuffer(x, "<u4") for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; the space in front goes. Bytes that aren't UTF-8 become U+FFFD, ids out of range raise."""
        text = b"".join(map(self.pieces.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    """A worker's codec, kept from task to task."""
    return Codec(Pieces.load(model))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """({id_col}, ids, n_ids, ids_crc32, exact): a row for each row of docs; ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers,
    exact whether decoding the ids gives the text back.

    A null or empty text has no ids and is exact. Repeated rows and null ids stay; other columns aren't returned. Texts are encoded whole, whatever their length.
    """
    model = model or default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for f in frames:
            for lo, hi in cuts([*map(len, f["text"])], BATCH_CHARS):
                texts = f["text"].iloc[lo:hi].tolist()
                coded = own.encode_all(texts)
                rows = [(ids.astype(np.int32), len(ids), zlib.crc32(ids.tobytes()), own.decode(ids.tolist()) == t) for ids, t in zip(coded, texts)]
                out = pd.DataFrame(rows, columns=["ids", "n_ids", "ids_crc32", "exact"])
                out.insert(0, "id", f["id"].iloc[lo:hi].to_numpy())
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = rows.mapInPandas(run, "id string, ids array<int>, n_ids long, ids_crc32 long, exact boolean")
    return coded.select(F.col("id").cast(kind).alias(id_col), "ids", "n_ids", "ids_crc32", "exact")


def decode_pieces(coded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """({id_col}, text): the texts of ids. Null ids give a null text, no ids an empty one."""
    model = model or default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "text": [None if x is None else own.decode(x) for x in f["ids"]]})

    kind = coded.schema[id_col].dataType.simpleString()
    rows = coded.select(F.col(id_col).cast("string").alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, "id string, text string")
    return rows.select(F.col("id").cast(kind).alias(id_col), "text")


def op3(docs: DataFrame) -> DataFrame:
    """Every document's ids, their number and checksum, and whether they decode to its text."""
    return encode_pieces(docs)
