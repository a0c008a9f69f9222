"""Secrets by fixed patterns, and by a comparison of two character Markov models.

Candidates are runs of 16 or more of ``A-Z a-z 0-9 + / _ = -`` with a letter. Each is scored by the
log-likelihood ratio of two models of order 2 (two characters predict the third,
falling back on fewer where they were rarely seen): one of random strings, one of ordinary identifiers. A run whose ratio, in nats, is at
least ``THRESHOLD`` in all and ``PER_CHAR`` a character is a ``random`` span.

The models are trained from labelled samples: (string, 1 for random). By default

* random: strings drawn with a fixed seed over the alphabets of keys and tokens (hex, upper case
  with digits, base 62, base 64), and the values that the fixed patterns find in the documents;
* ordinary: words of all documents, alone and joined as snake_case, kebab-case, camelCase
  and paths of up to ``JOINED`` words, with an occasional number.

Every document is read for training, so that a rare language or source is known as well. A task
sums its counts before it emits them; at most alphabet^3 a label are shuffled by a task and reach the
driver.

Edge cases: null text is empty; repeated rows give a row each; other columns are ignored; an empty
table gives no rows (the models then have the drawn strings only); whole texts are scanned.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm import spans
from cladeforge.llm.common import slices, texts

MIN_RUN = 16
THRESHOLD, PER_CHAR = 20.0, 1.5
JOINED, DRAWN = 4, 4_000
SMOOTHING = 8.0
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}  # 0: before the first character
_N = len(ALPHABET) + 1
_CODES = np.zeros(256, np.int64)
_CODES[list(ALPHABET.encode())] = np.arange(1, _N)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z]{2,}")
_LETTER = re.compile("[A-Za-z]")


def grams(text: str) -> list[int]:
    """Each character with the two before it, as one number."""
    a = b = 0
    out = []
    for c in text:
        n = _CODE[c]
        out.append((a * _N + b) * _N + n)
        a, b = b, n
    return out


def drawn_strings(count: int = DRAWN, seed: int = 11) -> Iterator[str]:
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits)
    for i in range(count):
        alphabet = alphabets[i % len(alphabets)]
        yield "".join(rng.choices(alphabet, k=rng.randint(16, 64)))


def identifiers(words: list[str], seed: int) -> Iterator[str]:
    """Words alone and joined as identifiers are."""
    rng = random.Random(seed)
    at = 0
    while at < len(words):
        n = rng.randint(1, JOINED)
        some = words[at : at + n]
        at += n
        yield from some
        style = rng.randrange(5)
        number = str(rng.randrange(100)) if rng.random() < 0.1 else ""
        if style == 0:
            yield "_".join(w.lower() for w in some) + number
        elif style == 1:
            yield "-".join(w.lower() for w in some) + number
        elif style == 2:
            yield some[0].lower() + "".join(w.capitalize() for w in some[1:]) + number
        elif style == 3:
            yield "/".join(some) + number
        else:
            yield "_".join(w.upper() for w in some) + number


class Models:
    """log-likelihood ratio of each gram, from counts of both labels."""

    def __init__(self, ordinary: np.ndarray, rand: np.ndarray):
        self.ratio = self._log(rand) - self._log(ordinary)

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        """Order 2 falls back on order 1, order 1 on order 0, order 0 on the even spread: each
        lends ``SMOOTHING`` observations."""
        c = counts.reshape(_N, _N, _N)
        p = (c.sum(axis=(0, 1)) + SMOOTHING / _N) / (c.sum() + SMOOTHING)
        pair = c.sum(axis=0)
        p = (pair + SMOOTHING * p) / (pair.sum(axis=1, keepdims=True) + SMOOTHING)
        p = (c + SMOOTHING * p[None]) / (c.sum(axis=2, keepdims=True) + SMOOTHING)
        return np.log(p).ravel().astype(np.float32)

    def score(self, run: str) -> float:
        return float(self.ratio[grams(run)].sum())

    def is_random(self, run: str) -> bool:
        if not _LETTER.search(run):
            return False
        score = self.score(run)
        return score >= THRESHOLD and score >= PER_CHAR * len(run)


def train(samples: Iterable[tuple[str, int]]) -> Models:
    """Models of labelled strings (string, 1 if random)."""
    counts = np.zeros((2, _N**3))
    for text, label in samples:
        np.add.at(counts[label], grams(text), 1)
    return Models(*counts)


def counted(values: list[str]) -> np.ndarray:
    """How often each gram is in the values; two marks of code 0 before each end the one before."""
    c = _CODES[np.frombuffer("".join(f"\0\0{v}" for v in values).encode(), np.uint8)]
    found = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
    return np.bincount(found[c[2:] > 0], minlength=_N**3)


def models(docs: DataFrame) -> Models:
    """Trained on all documents of the corpus and on drawn strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, _N**3), np.int64)
        for b in slices(batches):
            values: tuple[list[str], list[str]] = ([], [])
            for text in b.column("text").to_pylist():
                found = spans.secrets(text)
                for _, a, z in found:
                    values[1].extend(_RUN.findall(text[a:z]))
                words = [m[0] for m in spans.outside(_WORD, text, found)] if found else _WORD.findall(text)
                values[0].extend(identifiers(words, xxhash.xxh32_intdigest(text.encode())))
                if len(values[0]) >= 1 << 12:
                    n[0] += counted(values[0])
                    values[0].clear()
            for label in (0, 1):
                if values[label]:
                    n[label] += counted(values[label])
        label, gram = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int64()), "gram": pa.array(gram, pa.int64()), "n": pa.array(n[label, gram], pa.int64())})

    counts = np.zeros((2, _N**3))
    for r in texts(docs).mapInArrow(run, "label long, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r.label, r.gram] = r.n
    for text in drawn_strings():
        np.add.at(counts[1], grams(text), 1)
    return Models(*counts)


def random_runs(text: str, base: list[spans.Span], trained: Models) -> list[spans.Span]:
    return [("random", *m.span()) for m in spans.outside(_RUN, text, base) if trained.is_random(m[0])]


KINDS = (*spans.SECRET_KINDS, "random")


def report(docs: DataFrame, trained: Models | None = None) -> DataFrame:
    """A row per document: counts and digest of base spans, and all spans."""
    trained = trained or models(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base = spans.secrets(text)
                n = Counter(k for k, _, _ in base)
                every = spans.ordered(base + random_runs(text, base, trained), KINDS)
                rows.append((doc_id, *(n[k] for k in spans.SECRET_KINDS), spans.digest(base), spans.joined(every)))
            names = ["doc_id", *(f"n_{k}" for k in spans.SECRET_KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 4, pa.string(), pa.string()], strict=True)], names)

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, trained: Models | None = None, put: str = "[secret]") -> DataFrame:
    """The documents with every secret in text replaced; a null text stays null, other columns stay."""
    trained = trained or models(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                base = spans.secrets(text or "")
                every = base + random_runs(text or "", base, trained)
                out.append(spans.replaced(text, [(put, a, z) for _, a, z in every]) if every else text)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
