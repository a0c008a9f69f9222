"""Token ids of whole texts by the tokenizers library, one word at a time and many words a call.

The vocabulary file normalises (NFC, runs of white space to one space, lower case) and splits
so that white space ends every piece and is dropped. So a text's ids are the ids of its chunks
between white space, one after another, and a chunk that was seen before needs no second
encoding. Arrow splits the texts and finds the different chunks; in Latin-1, where lower case is
letter by letter and NFC changes nothing, these are put in lower case and the marks behind a word
are cut off, as letters and marks never share a piece. What is left are *words*, whose ids a memo
remembers; new ones go to the library, plain words many in one text (each ends with a token that
ends a word, so the ids fall apart again), others one by one.

The memo is Arrow and NumPy arrays, bounded in bytes: when full, only the words of the last texts
stay, so that frequent words stay and rare ones go.

Texts with U+001C to U+001F (white space to Arrow, not to the file's pattern) go to the library
whole. Strings of special tokens in a text are ordinary text (as the vocabulary folder's
notes advise), so a document can't smuggle in an end id; strings of other added tokens, which the
library cuts out first, send a text to the library whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids in the memo (the last texts may exceed it) if not told otherwise; the longest word (bytes) in it.
MEMO_BYTES, MEMO_WORD = 24 << 20, 64
#: Words in one text to the library, texts in one call (what it returns takes some 100 bytes a token).
JOINED, CALL = 64, 256
#: Chunks that are turned into ids or sums at a time (a text at least): each takes some 70 bytes meanwhile.
BLOCK = 1 << 16
END_ID = 2
_ODD = "[\x1c-\x1f]"
_LATIN = r"^[\x{00}-\x{ff}]*$"
_PLAIN = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"
#: Marks that may be cut off behind a letter or number (no apostrophe: the file's pattern has contractions).
MARKS = ".,!$%&*#|;:?"
_CUT = r"[\pL\pN]$"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of the given runs, one run after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _behind(whole: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows each head in its string."""
    whole = pa.concat_arrays([whole])
    sizes = np.asarray(pc.binary_length(heads), np.int64)
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset :][: len(whole) + 1].astype(np.int64)
    rest = np.diff(ends) - sizes
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] else np.empty(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(whole), pa.py_buffer(offsets.tobytes()), pa.py_buffer(gathered(data, ends[:-1] + sizes, rest).tobytes()))


class Encoded:
    """Texts as runs of chunks: ids() are all ids, each text's followed by END_ID."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, bounds: np.ndarray):
        """Chunk k has the ids flat[starts[k]:][:sizes[k]]; text i has the chunks at[bounds[i]:bounds[i + 1]]."""
        self.flat, self.starts, self.sizes, self.at, self.bounds = flat, starts, sizes, at, bounds
        self.offsets = np.concatenate([[0], np.cumsum(self._totals(sizes))])

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Runs of texts of about BLOCK chunks: which texts, their chunks, and where each text's begin and end there."""
        i, last = 0, len(self.bounds) - 1
        while i < last:
            j = max(i + 1, int(np.searchsorted(self.bounds, self.bounds[i] + BLOCK, "right")) - 1)
            yield slice(i, j), self.at[self.bounds[i] : self.bounds[j]], self.bounds[i : j + 1] - self.bounds[i]
            i = j

    def _totals(self, each: np.ndarray) -> np.ndarray:
        """For each text the sum over its chunks of a whole number a chunk."""
        out = np.empty(len(self.bounds) - 1, np.int64)
        for texts, at, bounds in self._blocks():
            out[texts] = np.diff(np.concatenate([[0], np.cumsum(each[at])])[bounds])
        return out

    def ids(self, kind: str = "<u4") -> np.ndarray:
        out = np.empty(self.offsets[-1], kind)
        for texts, at, _ in self._blocks():
            out[self.offsets[texts.start] : self.offsets[texts.stop]] = gathered(self.flat, self.starts[at], self.sizes[at])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of values[id] (whole numbers) over its ids; summed once a chunk."""
        upto = np.concatenate([[0], np.cumsum(values[self.flat], dtype=np.int64)])
        return self._totals(upto[self.starts + self.sizes] - upto[self.starts])


class ChunkTokenizer:
    def __init__(self, path: str, memo: int | None = None):
        from tokenizers import Tokenizer

        self.memo = memo or MEMO_BYTES
        self.library = Tokenizer.from_file(path)
        self.vocabulary_size = self.library.get_vocab_size(with_added_tokens=True)
        self.library.encode_special_tokens = True
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if not t.special]
        self.ends_word = np.zeros(self.vocabulary_size, bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.offsets = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0][:-1].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by END_ID, and where each text's begin and end."""
        found = self.chunks(texts)
        return found.ids(), found.offsets

    def chunks(self, texts: pa.Array) -> Encoded:
        odd = pc.match_substring_regex(texts, _ODD)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        if pc.any(odd).as_py():
            alone = [np.frombuffer(self.whole(t), np.uint32) for t in texts.filter(odd).to_pylist()]
            return self._split(pc.if_else(odd, "", texts), np.flatnonzero(odd.to_numpy(zero_copy_only=False)), alone)
        return self._split(texts, np.empty(0, np.int64), [])

    def _split(self, texts: pa.Array, odd: np.ndarray, alone: list[np.ndarray]) -> Encoded:
        """The texts' chunks; the odd ones, empty here, have their ids in ``alone``, one chunk each."""
        split = pc.utf8_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        flat, starts, sizes = self._table(chunks.dictionary)
        # the end id and the whole texts are chunks behind those of the table
        more = np.array([1, *map(len, alone)], np.int64)
        starts = np.concatenate([starts, len(flat) + np.cumsum(more) - more])
        flat, end = np.concatenate([flat, np.array([END_ID], np.uint32), *alone]), len(sizes)
        sizes = np.concatenate([sizes, more])
        bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        places, put = bounds[1:], np.full(len(texts), end, np.int32)
        if len(odd):
            places, put = np.concatenate([bounds[1:][odd], places]), np.concatenate([np.arange(end + 1, end + 1 + len(odd), dtype=np.int32), put])
        at = np.insert(chunks.indices.to_numpy(zero_copy_only=False), places, put)
        own = np.ones(len(texts), np.int64)
        own[odd] += 1
        return Encoded(flat, starts, sizes, at, bounds + np.concatenate([[0], np.cumsum(own)]))

    def _table(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different chunks: all ids, and where each chunk's begin and how many there are."""
        if not len(chunks):
            return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        latin = pc.match_substring_regex(chunks, _LATIN)
        low = pc.if_else(latin, pc.utf8_lower(chunks), chunks)
        bare = pc.ascii_rtrim(low, characters=MARKS)
        words = pc.if_else(pc.and_(latin, pc.match_substring_regex(bare, _CUT)), bare, low)
        both = pa.concat_arrays([words, _behind(low, words)]).dictionary_encode()
        entry = self._known(both.dictionary)
        first, last = np.split(entry[both.indices.to_numpy(zero_copy_only=False)], 2)
        starts, ends = self.offsets[:-1], self.offsets[1:]
        pair = np.stack([first, last], axis=1).ravel()
        lengths = (ends - starts)[pair]
        flat = gathered(self.flat, starts[pair], lengths)
        sizes = lengths[::2] + lengths[1::2]
        self._trim(entry)
        return flat, np.cumsum(sizes) - sizes, sizes

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the memo, which takes up the new ones."""
        at = pc.index_in(words, value_set=self.words)
        fresh = pc.is_null(at)
        out = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(fresh)
        if len(new):
            plain = pc.match_substring_regex(new, _PLAIN)
            groups = [new.filter(plain), new.filter(pc.invert(plain))]
            ids, sizes = zip(*(f(g.to_pylist()) for f, g in zip((self._plain, self._single), groups, strict=True)), strict=True)
            is_plain = plain.to_numpy(zero_copy_only=False)
            place = np.where(is_plain, np.cumsum(is_plain) - 1, len(groups[0]) + np.cumsum(~is_plain) - 1)
            out[fresh.to_numpy(zero_copy_only=False)] = len(self.words) + place
            self.words = pa.concat_arrays([self.words, *groups])
            self.flat = np.concatenate([self.flat, *ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(sizes))])
        return out

    def _called(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, some texts a call."""
        for a in range(0, len(texts), CALL):
            yield from [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts[a : a + CALL], add_special_tokens=False)]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word of small Latin letters."""
        ids = np.concatenate([np.empty(0, np.uint32), *self._called([" ".join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)])])
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words):
            return self._single(words)
        return ids, np.diff(stops, prepend=0)

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(self._called(words))
        return np.concatenate([np.empty(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _trim(self, used: np.ndarray) -> None:
        """Past its bound the memo keeps the words that were just used, long ones left out."""
        if self.words.nbytes + self.flat.nbytes + self.offsets.nbytes <= self.memo:
            return
        some = np.unique(used)
        words = self.words.take(pa.array(some))
        short = pc.less_equal(pc.binary_length(words), MEMO_WORD).to_numpy(zero_copy_only=False)
        some, words = some[short], words.filter(pa.array(short))
        starts, sizes = self.offsets[some], np.diff(self.offsets)[some]
        self.words, self.flat, self.offsets = words, gathered(self.flat, starts, sizes), np.concatenate([[0], np.cumsum(sizes)])
        if self.words.nbytes + self.flat.nbytes + self.offsets.nbytes > self.memo // 2:
            self._forget()


@functools.cache
def tokenizer(path: str, memo: int | None = None) -> ChunkTokenizer:
    """One per Python worker and size of memo."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkTokenizer(path, memo)
