"""BLAKE3 and the draw generator, which Spark has no functions for.

BLAKE3 is written from its public specification; the constants are fixed values. SplitMix64 is the
published generator. Draws need wrapping 64-bit arithmetic, so they are made in NumPy.
"""

from __future__ import annotations

import numpy as np

_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_U32 = np.uint32


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> _U32(n) | x << _U32(32 - n)


def _compress(chain: np.ndarray, block: np.ndarray, counter: int, length: int, flags: int) -> np.ndarray:
    """chain uint32[8, lanes], block uint32[16, lanes] -> uint32[8, lanes]."""
    lanes = block.shape[1]
    fixed = np.array([*_IV[:4], counter & 0xFFFFFFFF, counter >> 32, length, flags], _U32)[:, None]
    v = np.concatenate([chain, np.broadcast_to(fixed, (8, lanes))]).copy()
    m = block
    for turn in range(7):
        for q, (a, b, c, d) in enumerate(_QUARTERS):
            for word, x, y in ((m[2 * q], 16, 12), (m[2 * q + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turn(v[d] ^ v[a], x)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], y)
        if turn < 6:
            m = m[list(_PERMUTATION)]
    return v[:8] ^ v[8:]


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data.ljust(64, b"\0"), "<u4").astype(_U32)[:, None]


def _chunk(data: bytes, index: int, root: bool) -> np.ndarray:
    chain = np.array(_IV, _U32)[:, None]
    starts = range(0, max(1, len(data)), 64)
    for at in starts:
        part, last = data[at : at + 64], at == starts[-1]
        flags = _START * (at == 0) | _END * last | _ROOT * (root and last)
        chain = _compress(chain, _words(part), index, len(part), flags)
    return chain


def _tree(data: bytes, first: int, root: bool) -> np.ndarray:
    if len(data) <= 1024:
        return _chunk(data, first, root)
    left = 1024 << ((len(data) - 1) // 1024).bit_length() - 1
    both = np.concatenate([_tree(data[:left], first, False), _tree(data[left:], first + left // 1024, False)])
    return _compress(np.array(_IV, _U32)[:, None], both, 0, 64, _PARENT | _ROOT * root)


def blake3(data: bytes) -> bytes:
    """The 32-byte digest."""
    with np.errstate(over="ignore"):
        return _tree(data, 0, True)[:, 0].astype("<u4").tobytes()


def blake3_short(rows: np.ndarray) -> np.ndarray:
    """The first 8 bytes, as uint64, of the digest of each row of uint8[lanes, n], n up to 64."""
    lanes, n = rows.shape
    block = np.zeros((lanes, 64), np.uint8)
    block[:, :n] = rows
    with np.errstate(over="ignore"):
        out = _compress(np.broadcast_to(np.array(_IV, _U32)[:, None], (8, lanes)), block.view("<u4").astype(_U32).T, 0, n, _START | _END | _ROOT)
    return out[0].astype(np.uint64) | out[1].astype(np.uint64) << np.uint64(32)


_GAMMA, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class SplitMix:
    """Many SplitMix64 streams side by side."""

    def __init__(self, seeds: np.ndarray):
        self.state = np.atleast_1d(seeds).astype(np.uint64).copy()

    def next(self, where: np.ndarray | None = None) -> np.ndarray:
        where = np.ones(len(self.state), bool) if where is None else where
        with np.errstate(over="ignore"):
            self.state[where] += _GAMMA
            z = self.state[where]
            z = (z ^ z >> np.uint64(30)) * _MIX1
            z = (z ^ z >> np.uint64(27)) * _MIX2
            return z ^ z >> np.uint64(31)

    def bounded(self, n: np.ndarray | int) -> np.ndarray:
        """Below n in each stream, without bias: values over the last multiple of n are drawn anew."""
        n = np.broadcast_to(np.asarray(n, np.uint64), self.state.shape)
        with np.errstate(over="ignore"):
            least = (np.uint64(0) - n) % n  # 2^64 mod n
        limit = np.uint64(0) - least  # 0: every value is good
        out, todo = np.zeros(len(n), np.uint64), np.ones(len(n), bool)
        while todo.any():
            x = self.next(todo)
            good = (limit[todo] == 0) | (x < limit[todo])
            at = np.flatnonzero(todo)[good]
            out[at] = x[good] % n[at]
            todo[at] = False
        return out
