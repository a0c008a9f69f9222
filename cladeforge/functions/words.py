"""Normalised sequences, their words and sketches in NumPy, the twin of the expressions in sequences.py.

A word travels as its 16-bit code, two bits a base; letters are put back for output only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cladeforge.functions.sequences import IUPAC, SKETCH, WORD_SPACE, K

_NORMAL = np.full(256, ord("N"), np.uint8)
_KNOWN = np.zeros(256, bool)
for _c in IUPAC + "U":
    for _b in (ord(_c), ord(_c.lower())):
        _NORMAL[_b] = ord("T" if _c == "U" else _c)
        _KNOWN[_b] = True
_BASE = np.full(256, -1, np.int64)
_BASE[[ord(c) for c in "ACGT"]] = range(4)
_EVERY = np.arange(WORD_SPACE, dtype=np.int64)


def _permutation() -> np.ndarray:
    """The one-to-one hash of every code (see sequences.permuted)."""
    x = _EVERY ^ _EVERY >> 8
    x = x * 0x88B5 & 0xFFFF
    x = x ^ x >> 7
    x = x * 0xE1B5 & 0xFFFF
    return (x ^ x >> 9).astype(np.int32)


def _reversal() -> np.ndarray:
    """The code of every word's reverse complement."""
    out = np.zeros(WORD_SPACE, np.int64)
    for i in range(K):
        out = out << 2 | 3 - (_EVERY >> 2 * i & 3)
    return out.astype(np.int32)


PERMUTED, REVERSED = _permutation(), _reversal()


def normal(seq: str) -> tuple[np.ndarray, int]:
    """The normalised bytes and how many bytes were unknown."""
    raw = np.frombuffer(seq.encode(), np.uint8)
    return _NORMAL[raw], int((~_KNOWN[raw]).sum())


def codes(normalized: np.ndarray) -> np.ndarray:
    """The different word codes, ascending."""
    n = len(normalized) - K + 1
    if n < 1:
        return np.empty(0, np.int64)
    base = _BASE[normalized]
    bad = np.concatenate([[0], np.cumsum(base < 0)])
    out = np.zeros(n, np.int64)
    for i in range(K):
        out = out << 2 | np.maximum(base[i : i + n], 0)
    return np.unique(out[bad[K:] == bad[:-K]])


def lists(many: list[np.ndarray]) -> pa.ListArray:
    """Lists of ints."""
    flat = np.concatenate([np.empty(0, np.int32), *many]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, many)]), pa.int32()), pa.array(flat))


def sketch(own: np.ndarray) -> np.ndarray:
    """The SKETCH smallest hashes of different codes, ascending."""
    hashes = PERMUTED[own]
    return np.sort(np.partition(hashes, SKETCH - 1)[:SKETCH] if len(hashes) > SKETCH else hashes)


def reversed_lists(words: pa.ListArray) -> pa.ListArray:
    """The vocabularies of the other strand, each ascending."""
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = REVERSED[words.values.to_numpy()[bounds[0] : bounds[-1]]].astype(np.int64)
    row = np.repeat(np.arange(len(words)), np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array((np.sort(row * WORD_SPACE + flat) % WORD_SPACE).astype(np.int32)))
