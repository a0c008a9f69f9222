"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled 1; documents at large are unlabelled. Negative labels are
not used. A small network g over features of the whole text minimises the non-negative unbiased
risk (prior p, logistic loss l):

    p * E_pos l(g) + max(0, E_unl l(-g) - p * E_pos l(-g))

Where the second term falls below zero its gradient is reversed, as the method prescribes. The
class prior is estimated: a classifier of positives against unlabelled is trained on one half; on
the other, the least ratio (with a confidence term) of the unlabelled share to the positive share
above a cut, over all cuts, bounds and estimates the prior (best-bin estimation); the lower end of
the estimate, WIDTH standard errors down, is taken.

Features: shares of character classes and of each ASCII mark, word lengths, repetition of adjacent
and of all words. Never id, source, language or label.

Training sees at most POSITIVES + UNLABELLED documents (those of the smallest hash of the id outside
the held-out fold); scoring sees every whole text, in one pass without a shuffle.

Edge cases: a null text is empty and scored like one; repeated rows give a row each; without any
positive outside the held-out fold nothing can be learned and every score is 1 (nothing is
rejected); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm import labelled
from cladeforge.llm.common import slices, texts

POSITIVES, UNLABELLED = 6_000, 9_000
THRESHOLD = 0.7
HIDDEN, STEPS, RATE, DECAY = 12, 600, 0.02, 1e-4
WIDTH = 1.3
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
FEATURES = 17 + len(_MARKS)


def features(text: str) -> np.ndarray:
    data = text.encode()
    n = max(1, len(data))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    upper, lower, digit, wide = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    white = c[32] + c[9:14].sum()
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    pairs = sum(map(eq, words, words[1:])) / max(1, w - 1)
    different = len(set(words)) / w
    own = [
        np.log1p(len(text)), np.log1p(len(words)), upper, lower, digit, wide, white, upper / max(1e-9, upper + lower), c[10], c[_MARKS].sum(),
        pairs, different, different * np.log1p(w), sizes.mean() / 10, sizes.std() / 10, (sizes == 1).mean(), (sizes > 20).mean(),
    ]
    return np.concatenate([own, np.sqrt(c[_MARKS])])


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ self.parts[0] + self.parts[1]) @ self.parts[2] + self.parts[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self(x), -30, 30)))


def _softplus_gradient(z: np.ndarray) -> np.ndarray:
    """d/dz of log(1 + exp(z))."""
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softplus(z: np.ndarray) -> float:
    return float(np.logaddexp(0, z).mean())


def risk(parts: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk's two terms: of positives, and of unlabelled rows as negatives less the positives' share."""
    gp, gu = (np.tanh(x @ parts[0] + parts[1]) @ parts[2] + parts[3] for x in (p, u))
    return prior * _softplus(-gp), _softplus(gu) - prior * _softplus(gp)


def gradient(parts: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Of the non-negative risk: where its second term is below zero, that term's gradient alone, reversed.
    Without a prior, of plain positive against unlabelled."""
    hp, hu = np.tanh(p @ parts[0] + parts[1]), np.tanh(u @ parts[0] + parts[1])
    gp, gu = hp @ parts[2] + parts[3], hu @ parts[2] + parts[3]
    if prior is None:
        dp, du = -_softplus_gradient(-gp) / len(p), _softplus_gradient(gu) / len(u)
    else:
        sign = 1.0 if _softplus(gu) - prior * _softplus(gp) >= 0 else -1.0
        dp = -prior * _softplus_gradient(-gp) / len(p) * (sign > 0) - sign * prior * _softplus_gradient(gp) / len(p)
        du = sign * _softplus_gradient(gu) / len(u)
    grads = [np.zeros_like(w) for w in parts]
    for x, h, d in ((p, hp, dp), (u, hu, du)):
        back = d[:, None] * parts[2] * (1 - h * h)
        for g, more in zip(grads, (x.T @ back, back.sum(axis=0), h.T @ d, d.sum(keepdims=True)), strict=True):
            g += more
    return grads


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 5) -> Network:
    """Minimises the non-negative risk; without a prior, plain positive against unlabelled."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-3, [rng.normal(0, 0.3, (every.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)])
    p, u = (np.clip((x - net.mean) / net.scale, -8, 8) for x in (positive, unlabelled))
    first, second = [np.zeros_like(w) for w in net.parts], [np.zeros_like(w) for w in net.parts]
    for step in range(1, STEPS + 1):
        for i, g in enumerate(gradient(net.parts, p, u, prior)):
            g += DECAY * net.parts[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.parts[i] = net.parts[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled, by the best bin, at the lower end of its interval:
    too large a prior hides negatives, too small a one only lowers the positives' margin."""
    net = fit(positive[::2], unlabelled[::2], None)
    p, u = np.sort(net(positive[1::2])), np.sort(net(unlabelled[1::2]))
    cuts = np.quantile(p, np.linspace(0, 0.98, 50))
    qp, qu = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    wide = 0.5 * WIDTH * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))  # a share's standard error is 0.5 / sqrt(n) at most
    best = np.argmin((qu + wide) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9) - wide, 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network | None:
    """From bounded samples; None without positives."""
    sure = labelled.training_ids(labels.where("quality = 1"), positives).select("doc_id", F.lit(1).alias("positive"))
    large = labelled.training_ids(docs, unlabelled).select("doc_id", F.lit(0).alias("positive"))
    ids = F.broadcast(sure.unionAll(large).distinct())  # at most positives + unlabelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "positive", "x"])

    # a row an id and set, however often an id is used
    some = texts(docs).join(ids, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    rows = some.mapInArrow(run, "doc_id long, positive int, x binary").collect()
    rows.sort(key=lambda r: (r.positive, r.doc_id if r.doc_id is not None else -1, r.x))
    p, u = (np.array([np.frombuffer(r.x) for r in rows if r.positive == k]).reshape(-1, FEATURES) for k in (1, 0))
    if not len(p) or not len(u):
        return None
    return fit(p, u, estimate_prior(p, u) if len(p) > 3 and len(u) > 3 else 0.5)


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            many = b.column("text").to_pylist()
            got = net.probability(np.array([features(t) for t in many])) if net else np.ones(len(many))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    net = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            many = [t or "" for t in b.column("text").to_pylist()]
            good = net.probability(np.array([features(t) for t in many])) >= THRESHOLD if net else np.ones(len(many), bool)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
