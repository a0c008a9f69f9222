"""Byte-level BPE by a two-tier lookup, and back.

Tier 1: a minimal perfect hash over the vocabulary's byte strings (hash and displace: a string's
bucket holds a seed, the seeded hash is its slot, there are as many slots as strings; the stored
string is compared, so strangers are refused). A pre-token that is in the vocabulary is one id.

Tier 2: a miss starts as single bytes in a doubly linked list; a heap holds the ranks of adjacent
pairs with their place. The lowest rank (leftmost first) is merged, its neighbours' pairs are
pushed, stale heap entries are skipped: n log n, also for a pre-token of a whole text. Ranks of
pairs come from the perfect hash as well.

A bounded memo of resolved pre-tokens stands before both, as most pre-tokens repeat; when full it
becomes the old one, from which pre-tokens still in use move to the next.

Edge cases: null text is empty: no ids, digests of the empty string. Repeated rows give a row each, null
doc_ids are kept. A text of any length is encoded whole. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from cladeforge.llm.common import slices, texts

MEMO_TOKENS, MEMO_CHARS, MEMO_PAIRS = 300_000, 40, 100_000


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """bytes -> rank for a fixed set of distinct strings, one slot for each."""

    def __init__(self, ranks: dict[bytes, int], load: int = 2):
        n = self.slots = max(1, len(ranks))
        self.buckets = -(-n // load)
        groups: dict[int, list[bytes]] = {}
        for key in ranks:
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.ranks = [-1] * n
        for bucket, keys in sorted(groups.items(), key=lambda g: -len(g[1])):
            seed = 1
            while True:
                at = [xxhash.xxh3_64_intdigest(k, seed) % n for k in keys]
                if len(set(at)) == len(at) and all(self.keys[i] is None for i in at):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for k, i in zip(keys, at, strict=True):
                self.keys[i], self.ranks[i] = k, ranks[k]

    def get(self, key: bytes) -> int:
        """The rank, or -1."""
        slot = xxhash.xxh3_64_intdigest(key, self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]) % self.slots
        return self.ranks[slot] if self.keys[slot] == key else -1


class _Asked(dict):
    """The perfect hash's answers, remembered within a bound: merging asks for few strings often."""

    def __init__(self, hash_: PerfectHash):
        self.hash = hash_

    def __missing__(self, key: bytes) -> int:
        if len(self) >= MEMO_PAIRS:
            self.clear()
        known = self[key] = self.hash.get(key)
        return known


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.hash = PerfectHash(ranks)
        self.find = regex.compile(pattern).findall
        self.bytes_of = {r: k for k, r in ranks.items()}
        self.text_of = {r: str(r) for r in ranks.values()}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pairs = _Asked(self.hash)

    def merge(self, data: bytes) -> tuple[int, ...]:
        rank, n = self.pairs.__getitem__, len(data)
        piece: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, size = pop(heap)
            left, j = piece[i], after[i]
            if left is None or j >= n or len(left) + len(piece[j]) != size:
                continue
            piece[i] = left = left + piece[j]
            piece[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(both := left + piece[k])) >= 0:
                    push(heap, (r, i, len(both)))
            if (h := before[i]) >= 0 and (r := rank(both := piece[h] + left)) >= 0:
                push(heap, (r, h, len(both)))
        return tuple([rank(p) for p in piece if p is not None])

    def resolve(self, token: str) -> tuple[int, ...]:
        """The ids of one pre-token, from both tiers; kept in the memo."""
        ids = self.old.get(token)
        if ids is None:
            data = token.encode()
            whole = self.hash.get(data)
            ids = (whole,) if whole >= 0 else self.merge(data)
        if len(token) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_TOKENS:
                self.old, self.memo = self.memo, {}
            self.memo[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        tokens, memo = self.find(text), self.memo
        try:
            return list(chain.from_iterable(map(memo.__getitem__, tokens)))
        except KeyError:
            out: list[int] = []
            for token in tokens:
                out += self.memo.get(token) or self.resolve(token)
            return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def codec(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(bpe.encode, b.column("text").to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in slices(batches):
            out = [None if x is None else bpe.decode(x).decode(errors="replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in slices(batches):
            n, coded, decoded = [], [], []
            for text in b.column("text").to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or vocabulary_path(), pattern or public_tokenizers.PATTERN
