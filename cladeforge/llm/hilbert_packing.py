"""Packing documents into sequences along a space-filling curve.

1. A document's tokens are hashed into a sparse vector; each token's hash also gives its fixed
   random direction in ``DIMENSIONS`` dimensions (a projection of the hashed vector), so the
   projected vector is the sum of its tokens' directions. Directions are whole numbers and are summed
   once for each different chunk of text, so sums are exact however texts are batched.
2. The projected vector is brought to length one, so that long documents spread like short ones, and
   each coordinate is cut into 2^ORDER cells; the Hilbert curve through the cells gives the key.
3. Documents are sorted by range of the key (ties by a hash of id and row, so that a mass of equal
   documents, which have equal keys, spreads over ranges) and packed in that order: neighbours on
   the curve, so documents of like vocabulary, share sequences. Ranges hold about equally many
   *tokens*, not rows: their bounds come from a sample of keys and lengths (``SAMPLED`` rows a range),
   which affects balance only. There is a range for every RANGE_TOKENS tokens at least.
4. A range is one stream of ids, cut every ``capacity`` ids. Its rest is cut into powers of two,
   largest first, which need no padding: no id is dropped and nothing is padded.

Sequence ids are range * 2^32 + number within the range. Token ids are written once, in the shared
folder, then moved once by key.

Edge cases: a null text is empty and still has its end id; repeated rows are packed each; null
doc_ids are packed too. Texts longer than a sequence are cut; a text of any length is read whole. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.chunk_tokens import tokenizer, vocabulary_path
from cladeforge.llm.common import batch_bytes, materialise, partitions, release, slices, text_slices, texts

CAPACITY = 4096
DIMENSIONS, ORDER = 4, 10
TIE_BITS = 20
RANGE_TOKENS, SAMPLED = 1 << 25, 100
#: Bytes of text that a worker takes apart at a time, of the words that it remembers, and of a batch that it is sent:
#: an executor's memory is that of its heap, which fills up over the stages before, and of all its workers.
SLICE, MEMO, BATCH = 1 << 21, 8 << 20, 1 << 22


def hilbert_key(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Keys of points uint[n, d] with coordinates below 2^order, along the Hilbert curve.

    Skilling's transform from axes to the transposed index, then the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


@functools.cache
def directions(size: int, dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """A fixed direction for each token id, from its hash: odd numbers within 2^16 of zero, by dimension."""
    h = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(size)], np.uint64)
    return [2 * (h >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) - 0xFFFF for k in range(dimensions)]


def cells(sums: np.ndarray) -> np.ndarray:
    """The cell of each projected vector, the rows of sums."""
    where = sums / np.maximum(1.0, np.sqrt((sums * sums.astype(np.float64)).sum(axis=1, keepdims=True)))
    return np.minimum((0.5 + 0.5 * where) * (1 << ORDER), (1 << ORDER) - 1).astype(np.uint32)


def powers(rest: int) -> list[int]:
    """rest as powers of two, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Packer:
    """Cuts a stream of documents (their ids as bytes, u32) into sequences of one range.

    Holds the documents of the unfinished sequence only.
    """

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.held: deque[tuple] = deque()
        self.size = 0

    def _fill(self, room: int) -> Iterator[tuple]:
        offset = 0
        while offset < room:
            doc_id, ids, start = self.held.popleft()
            n = len(ids) // 4
            take = min(room - offset, n - start)
            part = ids[4 * start : 4 * (start + take)]
            yield doc_id, start, take, zlib.crc32(part), n, self.sequence, offset, part
            offset += take
            if start + take < n:
                self.held.appendleft((doc_id, ids, start + take))
        self.size -= room
        self.sequence += 1

    def add(self, doc_id, ids) -> Iterator[tuple]:
        self.held.append((doc_id, memoryview(ids), 0))
        self.size += len(ids) // 4
        while self.size >= self.capacity:
            yield from self._fill(self.capacity)

    def close(self) -> Iterator[tuple]:
        for power in powers(self.size):
            yield from self._fill(power)


def stored(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, curve (the key with ties broken), n, ids (binary, u16 or u32 as the vocabulary needs)."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary, MEMO)
        size = tok.vocabulary_size
        for b in text_slices(batches, SLICE):
            found = tok.chunks(b.column("text"))
            keys = hilbert_key(cells(np.stack([found.sums(d) for d in directions(size)], axis=1)))
            ids = found.ids(stored(size))
            ends = (found.offsets * ids.itemsize).astype(np.int32)  # a slice's ids stay far below 2^31 bytes
            data = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array(np.diff(found.offsets)), data], ["doc_id", "key", "n", "ids"])
            del found, keys, ids, ends, data
            release()

    found = texts(docs).mapInArrow(run, "doc_id long, key long, n long, ids binary")
    tie = F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    return found.select("doc_id", (F.shiftleft("key", TIE_BITS) + tie).alias("curve"), "n", "ids")


def bounds(found: DataFrame, least: int) -> list[int]:
    """The first keys of all ranges but the first, such that ranges hold about equally many tokens."""
    rows, tokens = found.agg(F.count("*"), F.sum("n")).first()
    ranges = max(least, -(-(tokens or 0) // RANGE_TOKENS))
    wanted = SAMPLED * ranges
    some = found.select("curve", "n")
    if rows > wanted:
        some = some.sample(wanted / rows, 3)
    some = some.toArrow()  # about ``wanted`` rows of two numbers
    key, n = (some.column(c).to_numpy() for c in ("curve", "n"))
    order = np.argsort(key, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    at = np.searchsorted(before, before[-1] * np.arange(1, ranges) / ranges) if len(key) else []
    return sorted({int(k) for k in key[order][at]})


def place(key: str, at: list[int]) -> F.Column:
    """How many of the ascending bounds are at most the key: looked up by steps, then within a step."""
    if not at:
        return F.lit(0)
    step = math.isqrt(len(at)) + 1
    array = lambda values: F.from_json(F.lit(str(list(values))), "array<bigint>")
    upto = lambda some: F.size(F.filter(some, lambda b: b <= F.col(key)))
    whole = upto(array(at[step - 1 :: step])) * step
    return whole + upto(F.slice(array(at), whole + 1, step))


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_PIECE = ", ".join(f"{name} long" for name in _COLUMNS)


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece; with ``keep_ids`` also its ids (binary, u32)."""

    vocabulary = vocabulary or vocabulary_path()

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True))
        out = {name: pa.array(c, pa.int64()) for name, c in zip(_COLUMNS, columns, strict=False)}
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(map(bytes, columns[-1]), pa.binary())} if keep_ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(TaskContext.get().partitionId() << 32, capacity), stored(tokenizer(vocabulary, MEMO).vocabulary_size)
        for b in slices(batches):
            pieces = [p for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True) for p in packer.add(d, np.frombuffer(x, kind).astype('<u4').tobytes())]
            if pieces:
                yield rows(pieces)
        if pieces := list(packer.close()):
            yield rows(pieces)

    with batch_bytes(docs.sparkSession, BATCH):
        ids = materialise(encoded(docs, vocabulary), "encoded")
    at = bounds(ids, partitions(docs.sparkSession))
    ordered = ids.withColumn("range", place("curve", at)).repartitionById(len(at) + 1, F.col("range").cast("int")).sortWithinPartitions("curve", "doc_id", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(run, _PIECE + (", ids binary" if keep_ids else ""))
