"""Order MinHash signatures of whole texts.

The elements of a text are its k-mers of code points, each with its occurrence number (first,
second, ... time that k-mer is met). For each of ``functions`` hash functions the ``smallest``
elements are selected, put back into text order, and their tuple is hashed. Two texts agree at a
function only if the same elements are smallest and stand in the same order, so likeness (the
share of agreeing functions) falls with edits and with rearrangement, not only with changed sets.

Many texts are hashed at once: all k-mers of a batch lie in one array, sorted within each text to
number occurrences; a function multiplies (32 bits, an odd constant) and only values under a bound that
leaves a dozen a text are looked at. A text where that leaves too few is redone without the bound.

Edge cases: a null text is empty; a text shorter than k is padded with U+0000 to one k-mer, so
empty texts are alike; a text with fewer elements than ``smallest`` gives shorter tuples. Texts are
ordered by (doc_id, text): repeated doc_ids have one row each, and null doc_ids come first. A single
document is its own next one. A text of any length is read whole. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import materialise, partitions, slices, texts

K, FUNCTIONS, SMALLEST = 8, 32, 2
#: Code points hashed at once.
BATCH_CHARS = 1 << 17
_POSITION = np.uint64((1 << 20) - 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _constants(functions: int) -> np.ndarray:
    return (_mix(np.arange(1, functions + 1, dtype=np.uint64) * _GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every window of k values, in log k steps."""
    base = np.uint64(0x100000001B3)
    out, size, done = np.zeros(len(codes) - k + 1, np.uint64), 1, 0
    power, run = base, codes.astype(np.uint64)
    rest = k
    while rest:
        if rest & 1:
            out = out * power + run[done : done + len(out)]
            done += size
        rest >>= 1
        if rest:
            run = run[:-size] * power + run[size:]
            size *= 2
            power = power * power
    return _mix(out)


def signatures(many: list[str], k: int = K, functions: int = FUNCTIONS, smallest: int = SMALLEST) -> np.ndarray:
    """uint32[texts, functions]."""
    out = np.empty((len(many), functions), np.uint32)
    if not len(many):
        return out
    padded = [t if len(t) >= k else t + "\0" * (k - len(t)) for t in many]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded)) - (k - 1)
    with np.errstate(over="ignore"):
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
        windows = _kmers(codes, k)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        grams, place = np.empty(starts[-1], np.uint64), np.empty(starts[-1], np.int64)
        at = 0
        for i, n in enumerate(sizes.tolist()):
            own, to = windows[at : at + n], slice(starts[i], starts[i + 1])
            if n <= 1 << 20:  # the sort carries the position in the low bits
                packed = np.sort((own & ~_POSITION) | np.arange(n, dtype=np.uint64))
                grams[to], place[to] = packed & ~_POSITION, packed & _POSITION
            else:
                place[to] = order = np.argsort(own & ~_POSITION, kind="stable")
                grams[to] = own[order] & ~_POSITION
            at += n + k - 1
        count = np.arange(len(grams))
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        new[starts[:-1]] = True
        occurrence = count - np.maximum.accumulate(np.where(new, count, 0))
        elements = (_mix(grams + occurrence.astype(np.uint64) * _GOLDEN) >> np.uint64(32)).astype(np.uint32)
        text_of = np.repeat(np.arange(len(many)), sizes)
        bound = np.minimum((1 << 32) - 1, (12.0 * 2**32) / sizes).astype(np.uint32)
        bounds, values, low = bound[text_of], np.empty_like(elements), np.empty(len(elements), bool)
        for f, c in enumerate(_constants(functions)):
            np.multiply(elements, c, out=values)
            np.less_equal(values, bounds, out=low)
            some = np.flatnonzero(low)
            out[:, f] = _select(values, some, text_of, grams, place, smallest, len(many))
            enough = np.bincount(text_of[some], minlength=len(many)) >= np.minimum(smallest, sizes)
            for i in np.flatnonzero(~enough):
                every = np.arange(starts[i], starts[i + 1])
                out[i, f] = _select(values, every, text_of, grams, place, smallest, len(many))[i]
    return out


def _select(values, some, text_of, grams, place, smallest, n) -> np.ndarray:
    """The tuple hash of the smallest values among ``some``, for each text."""
    owner = text_of[some]
    order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | values[some], kind="stable")
    some, owner = some[order], owner[order]
    first = np.searchsorted(owner, np.arange(n))
    rank = np.arange(len(some)) - first[owner]
    some, owner = some[rank < smallest], owner[rank < smallest]
    inside = np.lexsort((place[some], owner))
    some, owner = some[inside], owner[inside]
    rank = np.arange(len(some)) - np.searchsorted(owner, np.arange(n))[owner]
    total = np.zeros(n, np.uint64)
    for r in range(smallest):
        now = rank == r
        total[owner[now]] = _mix(total[owner[now]] * _M2 + grams[some[now]] + _GOLDEN)
    return (total >> np.uint64(32)).astype(np.uint32)


def as_text(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing functions, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _digest(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, many: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> dict:
    changed = [edited(t, n) for t, n in zip(many, following, strict=True)]
    other = signatures(changed)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array(map(len, many), pa.int64()),
        "edited_sha256": [_digest(t) for t in changed],
        "fingerprint": [as_text(r) for r in prints],
        "edited_fingerprint": [as_text(r) for r in other],
        "near_edited": pa.array(likeness(prints, other)),
        "near_next": pa.array(likeness(prints, next_prints)),
    }


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, many, size = [], [], 0
    for b in slices(batches, 64):
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i)
            many.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield ids, many
                ids, many, size = [], [], 0
    if ids:
        yield ids, many


def neighbours(docs: DataFrame) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and how near both the edited
    and the next document (ascending doc_id; after the last the first) are.

    Texts are moved once, into ranges of doc_id. Only the last document of a range needs another
    range: each range leaves its first and last document, which are joined range to next range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, first = None, None
        for ids, many in _groups(batches):
            prints = signatures(many)
            if first is None:
                first = many[0]
            if held is not None:
                ids, many, prints = [held[0], *ids], [held[1], *many], np.vstack([held[2], prints])
            held = (ids[-1], many[-1], prints[-1])
            if len(ids) > 1:
                done = _rows(ids[:-1], many[:-1], many[1:], prints[:-1], prints[1:])
                blank = pa.nulls(len(ids) - 1, pa.string())
                yield pa.RecordBatch.from_pydict({"part": pa.nulls(len(ids) - 1, pa.int64()), **done, "first": blank, "last": blank})
        if held is not None:
            none = {n: pa.nulls(1, t) for n, t in (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))}
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "doc_id": pa.array([held[0]], pa.int64()), **none, "first": [first], "last": [held[1]]})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            many, following = b.column("last").to_pylist(), b.column("following").to_pylist()
            yield pa.RecordBatch.from_pydict(_rows(b.column("doc_id").to_pylist(), many, following, signatures(many), signatures(following)))

    spark = docs.sparkSession
    ordered = texts(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    found = materialise(ordered.mapInArrow(run, f"part long, {_ROW}, first string, last string"), "order-minhash")
    ends = found.where("part is not null")
    parts = sorted(r.part for r in ends.select("part").collect())  # at most one for each partition
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part long, next_part long")
    pairs = ends.select("part", "doc_id", "last").join(follows, "part").join(ends.select(F.col("part").alias("next_part"), F.col("first").alias("following")), "next_part")
    closed = pairs.select("doc_id", "last", "following").mapInArrow(close, _ROW)
    return found.where("part is null").drop("part", "first", "last").unionByName(closed)
