"""Token ids in length-delimited binary records, with an offset index beside each file for shuffled reads.

A file is a run of records. A record is

    length   unsigned 64 bits, bytes of the payload
    check    unsigned 32 bits, masked CRC-32 of the eight length bytes
    payload  id of the document (signed 64 bits), flags (8 bits: 1 the id is null; 2 ids take 4 bytes, else 2), the ids
    check    unsigned 32 bits, masked CRC-32 of the payload

all little-endian. The mask, a rotation by 15 bits and an added constant, keeps a checksum of data that hold checksums from being weak.
The index beside it has a row of 24 bytes for each record: its offset, the ids in the file before it, and its number of ids.

Documents are dealt out by ranges of their ids, sorted in each range, encoded and written by the task that has the range. A task gives
each file a name of its own and returns it in a manifest row; only files that the written manifest names count, so that an attempt
that was lost or ran twice leaves nothing that is read. Files go to the shared folder through pyarrow.fs, which opens local paths and
the usual stores by their URI. Readers take one file a task; where a file's documents begin in the whole follows from the manifest.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, cuts, settle, shared_dir

END_ID = 2
#: A file is closed once it has so many bytes.
FILE_BYTES = 48 << 20
#: A worker remembers the ids of so many chunks, and of as many older ones.
CACHE = 300_000
_LENGTH, _CHECK, _HEAD, _INDEX = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB"), np.dtype([("offset", "<u8"), ("start", "<u8"), ("n", "<u8")])

#: White space as the byte-level pretokenizer sees it (Unicode's White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts at places where the pretokenizer cuts too, though at fewer of them: round white space, and between letters and a mark that ends a word.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?*#$%&|)"
WORD = re.compile(f" ?[{LETTERS}]+")
CHUNK = re.compile(f"{WORD.pattern}(?![^{SPACE}{MARKS}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
MANIFEST = "part int, seq int, file string, n_records long, n_ids long, n_bytes long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """Token ids of texts by the tokenizers library, as arrays of unsigned 32-bit integers.

    Byte-level pretokens never merge with one another, so the ids of a text are those of its chunks; a chunk is given to the library once and remembered.
    A text that holds a special token goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: the library's threads would only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.uint32)
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable characters of Latin-1 stand for themselves, the other bytes follow from 256 on.
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = dict(zip((b for b in range(256) if b not in kept), range(256, 512)))
        self.memo = Memo(self._chunks, CACHE)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind.char, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """A chunk of letters is one pretoken, and the model's alone; others go through all of the library's steps."""
        tokenize, kind, alphabet = self.model.tokenize, self.kind.char, self.alphabet
        out = [array(kind, [t.id for t in tokenize(c.encode().decode("latin-1").translate(alphabet))]).tobytes() if WORD.fullmatch(c) else None for c in chunks]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._library([chunks[i] for i in rest])):
            out[i] = ids
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = [not self.byte_level or any(s in t for s in self.special) for t in texts]
        chunks: list[str] = []
        ends = []
        for t, w in zip(texts, whole):
            if not w:
                chunks += CHUNK.findall(t)
            ends.append(len(chunks))
        ids = self.memo(chunks)
        return [np.frombuffer(self._library([t])[0] if w else b"".join(ids[lo:hi]), self.kind) for t, w, lo, hi in zip(texts, whole, [0, *ends], ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    payload = _HEAD.pack(doc_id or 0, (doc_id is None) | wide << 1) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked_crc(length)), payload, _CHECK.pack(masked_crc(payload))))


def unframe(stream) -> tuple[int | None, np.ndarray] | None:
    """The record at which the stream stands, or None at its end. A wrong checksum or a torn record raises."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or _CHECK.unpack(head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("a record's length is damaged")
    n = _LENGTH.unpack(head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or _CHECK.unpack(body[n:])[0] != masked_crc(body[:n]):
        raise ValueError("a record's payload is damaged")
    doc_id, flags = _HEAD.unpack_from(body)
    return None if flags & 1 else doc_id, np.frombuffer(body[_HEAD.size : n], "<u4" if flags & 2 else "<u2").astype("<u4")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _encoded(frames: Iterator[pd.DataFrame], encode: Encoder) -> Iterator[tuple[str | None, np.ndarray]]:
    """(id, ids) of each row, some texts at a time."""
    for f in frames:
        for lo, hi in cuts([*map(len, f["text"])], 1 << 20):
            yield from zip(f["id"].iloc[lo:hi], encode(f["text"].iloc[lo:hi].tolist()))


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes and writes all documents in ascending order of their ids (null first, repeats by text) below folder; returns the manifest (part, seq, file, n_records, n_ids, n_bytes), a row for each file.

    A null text is empty; its record holds the end id alone (nothing if end_id is None). Repeated rows have a record each. No rows: no files.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, root = _store(folder)
        end = np.array([] if end_id is None else [end_id], "<u4")
        out, path, index, at, ids_before = None, "", [], 0, 0
        done = []

        def close() -> None:
            nonlocal out, seq
            out.close()
            with store.open_output_stream(f"{root}/{path}.idx") as idx:
                idx.write(np.array(index, _INDEX).tobytes())
            done.append((part, seq, path, len(index), ids_before, at))
            out, seq = None, seq + 1

        for doc_id, ids in _encoded(frames, encode):
            if out is None:
                path, index, at, ids_before = f"part-{part:05d}-{seq:04d}-{uuid.uuid4().hex}.rec", [], 0, 0
                out = store.open_output_stream(f"{root}/{path}")
            ids = np.concatenate([ids.astype("<u4"), end])
            record = frame(None if doc_id is None else int(doc_id), ids)
            out.write(record)
            index.append((at, ids_before, len(ids)))
            at, ids_before = at + len(record), ids_before + len(ids)
            if at >= file_bytes:
                close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["part", "seq", "file", "n_records", "n_ids", "n_bytes"])

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Ids travel as strings: a null would make pandas turn them into floats.
    rows = docs.select(F.col(id_col).cast("long").alias("n"), text.alias("text"))
    rows = rows.repartitionByRange("n", F.xxhash64("text")).sortWithinPartitions("n", "text")
    return settle(rows.select(F.col("n").cast("string").alias("id"), "text").mapInPandas(run, MANIFEST))


def _each_record(manifest: DataFrame, folder: str, last: str, schema: str, make, batch_ids: int) -> DataFrame:
    """(doc_id, start, n_tokens, {last}): a row for each record of the manifest's files, start being the ids of all records before it. Each file is read by one task, batch_ids ids at a time."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = settle(manifest.withColumn("start", before).select("file", "start"))  # a row for each file
    columns = ["doc_id", "start", "n_tokens", last]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        for f in frames:
            for name, start in zip(f["file"], f["start"]):
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as stream:
                    while (record := unframe(stream)) is not None:
                        doc_id, ids = record
                        rows.append((None if doc_id is None else str(doc_id), start, len(ids), make(ids)))
                        start, held = start + len(ids), held + len(ids)
                        if held > batch_ids:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    read = files.repartition(max(1, min(files.count(), 10_000))).mapInPandas(run, f"doc_id string, start long, n_tokens long, {schema}")
    return read.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record of the manifest's files. A damaged file raises."""
    return _each_record(manifest, folder, "ids", "ids array<long>", lambda ids: ids.astype(np.int64), 1 << 20)


def digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record; ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers. The ids don't leave the tasks."""
    return _each_record(manifest, folder, "ids_crc32", "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), 1 << 23)


def offset_index(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, offset, start, n_tokens): the offset indexes of the manifest's files as a table, to be sampled or shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        for f in frames:
            for name in f["file"]:
                with store.open_input_stream(f"{root}/{name}.idx") as idx:
                    rows = np.frombuffer(idx.read(), _INDEX)
                yield pd.DataFrame({"file": name, "offset": rows["offset"].astype(np.int64), "start": rows["start"].astype(np.int64), "n_tokens": rows["n"].astype(np.int64)})

    return manifest.select("file").repartition(max(1, min(manifest.count(), 10_000))).mapInPandas(run, "file string, offset long, start long, n_tokens long")


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the records at the rows (file, offset) of index, in its order within each partition; each record is one seek and one read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        opened: dict = {}
        for f in frames:
            rows = []
            for name, offset in zip(f["file"], f["offset"]):
                if name not in opened:
                    if len(opened) > 64:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = store.open_input_file(f"{root}/{name}")
                opened[name].seek(int(offset))
                doc_id, ids = unframe(opened[name])
                rows.append((None if doc_id is None else str(doc_id), ids.astype(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    read = index.select("file", "offset").mapInPandas(run, "doc_id string, ids array<long>")
    return read.withColumn("doc_id", F.col("doc_id").cast("long"))


def op8(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files that write_records() wrote."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or shared_dir(docs.sparkSession)
    return digests(write_records(docs, folder, tokenizer), folder)

