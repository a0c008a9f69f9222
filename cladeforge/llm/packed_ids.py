"""Token-id files: fixed-width bit packing with block offsets.

A file holds the documents of one range of doc_id, in order. Each id takes the fewest bits that
the vocabulary needs. Layout, little-endian:

    magic "CFIDS02\\0" | bits u32 | block u32 | documents u64 | ids u64 | nulls u64
    doc_ids i64[documents] | starts u64[documents + 1] | block offsets u64[blocks + 1] | payload

``starts`` counts ids within the file. Ids are packed in blocks of ``block`` ids; a block begins
at a byte, its offset (from the payload's first byte) is stored, so any id is reached by one
seek, and a block is unpacked by a few numpy operations. A file is closed once it holds FILE_IDS
ids (after the texts at hand), so what a task holds in memory doesn't grow with its range. Files are
listed, with the ids before each of them, by the manifest that ``write`` returns; it comes from the
tasks that succeeded, so leftovers of lost tasks are never read.

Edge cases: a null text is an empty one (only the end id); repeated doc_ids keep one entry each;
documents of equal doc_id lie in the order of their text; null doc_ids come first (``nulls`` counts
them) and are read back as null. A text of any length is one document. Other columns are ignored. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.chunk_tokens import tokenizer, vocabulary_path
from cladeforge.llm.common import fresh_path, materialise, open_output, partitions, read_file, text_slices, texts

MAGIC, HEAD = b"CFIDS02\0", struct.Struct("<8sIIQQQ")
BLOCK = 4096
FILE_IDS = 1 << 23


def width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids of a block, low bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(data, "<u4", count).astype(np.uint32)
    planes = np.zeros((count, 32), np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Packs as documents come; holds the packed payload of one file, not its ids."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.doc_ids: list[int | None] = []
        self.starts, self.offsets = [0], [0]
        self.payload, self.rest = bytearray(), np.empty(0, np.uint32)

    def add(self, doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> None:
        """Documents, those without an id first, and where in ids each one's begin and end."""
        self.doc_ids += doc_ids
        self.starts += (offsets[1:] + self.starts[-1]).tolist()
        ids = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        full = len(ids) // self.block * self.block
        for at in range(0, full, self.block):
            self._put(ids[at : at + self.block])
        self.rest = ids[full:].copy()

    def _put(self, ids: np.ndarray) -> None:
        self.payload += pack(ids, self.bits)
        self.offsets.append(len(self.payload))

    def save(self, uri: str) -> None:
        if len(self.rest):
            self._put(self.rest)
            self.rest = self.rest[:0]
        with open_output(uri) as f:
            f.write(HEAD.pack(MAGIC, self.bits, self.block, len(self.doc_ids), self.starts[-1], self.doc_ids.count(None)))
            for values, kind in (([d or 0 for d in self.doc_ids], "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
                f.write(np.array(values, kind).tobytes())
            f.write(bytes(self.payload))


class Reader:
    def __init__(self, data: memoryview):
        magic, self.bits, self.block, documents, self.ids, self.nulls = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at, parts = HEAD.size, []
        for kind, n in (("<i8", documents), ("<u8", documents + 1), ("<u8", -(-self.ids // self.block) + 1)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += 8 * n
        ids, self.starts, self.offsets = parts
        self.doc_ids: list[int | None] = [None] * self.nulls + ids[self.nulls :].tolist()
        self.payload = data[at:]

    def read(self, start: int, count: int) -> np.ndarray:
        """The ids start to start + count of the file, touching only their blocks."""
        first, last = start // self.block, -(-(start + count) // self.block)
        if self.bits * self.block % 8 == 0 and count:  # blocks are contiguous: one unpacking for all
            n = min(self.ids, last * self.block) - first * self.block
            got = unpack(self.payload[int(self.offsets[first]) : int(self.offsets[last])], self.bits, n)
        else:
            got = np.concatenate([np.empty(0, np.uint32), *(unpack(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], self.bits, min(self.block, self.ids - b * self.block)) for b in range(first, last))])
        return got[start - first * self.block :][:count]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """Writes the files; a row per file: part and number (ascending with doc_id), path, documents, ids."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, out, part, number = tokenizer(vocabulary), None, TaskContext.get().partitionId(), 0

        def close(done: Writer) -> pa.RecordBatch:
            done.save(path := f"{folder}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids")
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "documents": [len(done.doc_ids)], "ids": [done.starts[-1]]})

        for b in text_slices(batches, 1 << 22):
            out = out or Writer(width(tok.vocabulary_size), block)
            ids, offsets = tok.encode_all(b.column("text"))
            out.add(b.column("doc_id").to_pylist(), offsets, ids)
            if out.starts[-1] >= FILE_IDS:
                yield close(out)
                out, number = None, number + 1
        if out:
            yield close(out)

    ordered = texts(docs).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "part long, number long, path string, documents long, ids long"), "manifest")


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with first_id, the ids in all files before. One row per file: a bounded list."""
    rows, before = [], 0
    for f in sorted(manifest.collect()):
        rows.append((f.path, before, f.ids))
        before += f.ids
    spark = manifest.sparkSession
    frame = spark.createDataFrame(rows, "path string, first_id long, ids long")
    return frame.repartition(max(1, len(rows))) if rows else frame


def read(files: DataFrame) -> DataFrame:
    """A row per document: doc_id, start (ids before it in all files), ids (binary, u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first_id").to_pylist(), strict=True):
                f = Reader(read_file(path))
                for at in range(0, len(f.doc_ids), 64):
                    some = range(at, min(at + 64, len(f.doc_ids)))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([f.doc_ids[k] for k in some], pa.int64()),
                        "start": [first + int(f.starts[k]) for k in some],
                        "ids": pa.array([f.document(k).tobytes() for k in some], pa.binary()),
                    })

    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def read_back(files: DataFrame) -> DataFrame:
    """A row per document read from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first_id").to_pylist(), strict=True):
                f = Reader(read_file(path))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(f.doc_ids, pa.int64()),
                    "start": pa.array(f.starts[:-1].astype(np.int64) + first),
                    "n_tokens": pa.array(np.diff(f.starts.astype(np.int64))),
                    "ids_crc32": pa.array([zlib.crc32(f.document(k)) for k in range(len(f.doc_ids))], pa.int64()),
                })

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read_back(located(write(docs, fresh_path(docs.sparkSession, "token-ids"), vocabulary)))
