"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: INSULT, THREAT, TARGET (who is addressed or spoken of), NEGATION, REPORT (a
verb of saying), OTHER. Three transducers read them and are composed into one:

* negation: an insult or threat within REACH words after a negation is passed on as negated;
* report: after a verb of saying, insults and threats of the clause are passed on as reported;
* clause: an insult, more so with a target in the clause before it, and a threat near a target
  make *events*; each event has a weight, lowered where negated or reported. A threat without a
  target is no event.

A clause (up to . ! ? ; : or a line's end) is scored by the sum of its events' weights times the
weight of the word that made each; a document by the logistic curve of the log of its clauses' sum.

The lexicon has a few general words of four languages, given below, and stems learned from labelled
documents: whole words and prefixes of 4 to 6 letters. Evidence are the different surroundings in
which toxic documents hold a stem (copies share theirs).

* What counts as more than chance depends on the sample: with EVIDENCE surroundings or more, a stem's
  log-likelihood ratio G2 must exceed twice the log of the number of stems tried, so that of stems
  without meaning less than one is expected to pass, at any sample size.
* Of those that pass, stems met nearly only in toxic documents (PRECISION) are learned. A prefix that one
  whole word accounts for (SPREAD) is left to that word.
* A prefix that passes but is met in clean documents too stands behind the whole words it begins: such a
  form needs two surroundings only, and the share of its documents that are toxic, taken together with
  BACKING documents of the prefix's share, must reach FORM. So inflected forms in rare languages are
  learned from a few labels, while the prefix alone flags nothing.

A stem's weight is its log-odds; the curve's two numbers are fitted on the same sample. A learned
stem is an insult to the grammar; alone it makes an event too, a weaker one than in a clause with
a target.

Training sees at most SAMPLE labelled documents (smallest hash of the id, held-out fold left out)
and the model has at most 2 STEMS stems; scoring sees every whole text in one pass without a shuffle.

Edge cases: a null text is empty; repeated rows give a row each; without toxic labels the given
words alone are used with a fixed curve; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm import labelled
from cladeforge.llm.common import materialise, slices, texts

SAMPLE, STEMS = 24_000, 20_000
EVIDENCE, PRECISION, SPREAD = 3, 0.9, 1.2
ODDS, BACKING, FORM = 1.5, 2.0, 0.7
THRESHOLD = 0.3
REACH = 3
PREFIXES = (4, 5, 6)
MEMO_WORDS, HELD_STEMS = 150_000, 100_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
WORDS = {
    INSULT: """idiot idiots moron morons imbecile dumbass scum scumbag loser losers pathetic worthless stupid disgusting vermin degenerate
        idioten trottel abschaum versager dummkopf widerling schwachkopf
        imbécile crétin crétine abruti ordure minable débile dégoûtant connard
        idiota imbécil estúpido estúpida escoria asqueroso patético""",
    THREAT: """kill murder hurt strangle shoot stab destroy beat slaughter
        töten umbringen erschießen erwürgen verprügeln
        tuer égorger étrangler abattre frapper
        matar asesinar estrangular degollar golpear""",
    TARGET: """you your yours yourself u him her them he she they his their everyone people
        du dich dir dein deine ihr euch sie ihn ihm ihnen alle leute
        tu toi te vous ton ta tes votre vos il elle ils elles lui leur eux gens
        tú ti usted ustedes vosotros él ella ellos ellas tus su sus gente""",
    NEGATION: """not never no isn't aren't wasn't weren't don't doesn't didn't won't nobody neither nor
        nicht nie niemals kein keine keinen niemand weder
        ne pas jamais aucun aucune personne ni
        nunca jamás ningún ninguna nadie tampoco""",
    REPORT: """said says called calls claimed wrote writes quoted reported alleged accused
        sagte sagt nannte behauptete schrieb schreibt zitierte berichtete
        dit disait appelé appela affirmait écrit écrivait cité accusé
        dijo dice llamó afirmó escribió escribe citó acusó""",
}
_FIXED = {w: kind for kind, words in WORDS.items() for w in words.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+")
#: Kinds that some transducer passes on: base kind + 8 if negated + 16 if reported.
NEGATED, REPORTED = 8, 16
EVENT_WEIGHT = {"insult": 1.0, "insult+target": 1.5, "threat": 2.0, NEGATED: 0.3, REPORTED: 0.4}


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, output symbol, weight); state 0 is the start."""

    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)
    states: int = 1

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(a: Transducer, b: Transducer, symbols: range) -> Transducer:
    """a, then b on what a puts out; weights add."""
    names, queue, out = {(0, 0): 0}, [(0, 0)], Transducer()
    while queue:
        pair = queue.pop()
        for s in symbols:
            x, middle, w = a.step(pair[0], s)
            y, end, v = b.step(pair[1], middle)
            if (x, y) not in names:
                names[x, y] = len(names)
                queue.append((x, y))
            out.arcs[names[pair], s] = (names[x, y], end, w + v)
    out.states = len(names)
    return out


def negation() -> Transducer:
    """State n: n more words stand under a negation."""
    t = Transducer(states=REACH + 1)
    for n in range(REACH + 1):
        for s in (OTHER, TARGET, REPORT):
            t.arcs[n, s] = (max(0, n - 1), s, 0.0)
        for s in (INSULT, THREAT):
            t.arcs[n, s] = (max(0, n - 1), s + (NEGATED if n else 0), 0.0)
        t.arcs[n, NEGATION] = (REACH, NEGATION, 0.0)
        t.arcs[n, BREAK] = (0, BREAK, 0.0)
    return t


def report() -> Transducer:
    """State 1: behind a verb of saying."""
    t = Transducer(states=2)
    for n in (0, 1):
        t.arcs[n, REPORT] = (1, REPORT, 0.0)
        t.arcs[n, BREAK] = (0, BREAK, 0.0)
        for s in (INSULT, THREAT):
            for more in (0, NEGATED):
                t.arcs[n, s + more] = (n, s + more + REPORTED * n, 0.0)
    return t


def clause() -> Transducer:
    """States: 0 nothing yet, 1 a target came, 2 + m a threat (marked m) waits for its target."""
    marks = (0, NEGATED, REPORTED, NEGATED + REPORTED)
    t = Transducer(states=2 + len(marks))

    def worth(event: str, mark: int) -> float:
        w = EVENT_WEIGHT[event]
        for m in (NEGATED, REPORTED):
            if mark & m:
                w *= EVENT_WEIGHT[m]
        return w

    for state in range(t.states):
        waiting = marks[state - 2] if state >= 2 else None
        t.arcs[state, BREAK] = (0, BREAK, 0.0)
        t.arcs[state, TARGET] = (1, TARGET, 0.0 if waiting is None else worth("threat", waiting))
        for k, m in enumerate(marks):
            t.arcs[state, INSULT + m] = (state, OTHER, worth("insult+target" if state == 1 else "insult", m))
            t.arcs[state, THREAT + m] = (1, OTHER, worth("threat", m)) if state == 1 else (2 + k, OTHER, 0.0)
    return t


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """next state and weight, by state and symbol, of the three composed."""
    symbols = range(BREAK + 1)
    t = compose(compose(negation(), report(), symbols), clause(), symbols)
    step, weight = np.zeros((t.states, len(symbols)), int), np.zeros((t.states, len(symbols)))
    for (state, s), (to, _, w) in t.arcs.items():
        step[state, s], weight[state, s] = to, w
    return step, weight


class Scorer:
    """Clause and document scores for a lexicon of stems (whole words end in a space)."""

    def __init__(self, stems: dict[str, float], curve: tuple[float, float] = (-3.0, 4.0)):
        self.stems, self.curve = stems, curve
        self.memo: dict[str, tuple[int, float]] = {}
        step, weight = grammar()
        self.step, self.weight = step.tolist(), weight.tolist()

    def symbol(self, word: str) -> tuple[int, float]:
        """The word's symbol and the weight of what it makes."""
        known = self.memo.get(word)
        if known is None:
            w = word.casefold().replace("’", "'")
            kind = BREAK if not w[0].isalpha() else _FIXED.get(w, OTHER)
            stem = max((self.stems.get(s, 0.0) for s in stems_of(w)), default=0.0)
            known = (INSULT, stem) if stem and kind in (OTHER, INSULT) else (kind, 1.0)
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = known
        return known

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the clauses with a score."""
        out, state, start, total, end = [], 0, 0, 0.0, 0
        for m in _TOKEN.finditer(text):
            kind, own = self.symbol(m[0])
            total += self.weight[state][kind] * own
            state = self.step[state][kind]
            end = m.end()
            if kind == BREAK:
                if total:
                    out.append((start, end, total))
                start, total = end, 0.0
        return [*out, (start, end, total)] if total else out

    def total(self, text: str) -> float:
        symbol = self.symbol
        if not any(symbol(w)[0] in (INSULT, THREAT) for w in set(_WORD.findall(text))):
            return 0.0
        return sum(c[2] for c in self.clauses(text))

    def score(self, text: str) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(self.total(text)), -30, 30))))


def stems_of(word: str) -> list[str]:
    return [word + " ", *(word[:n] for n in PREFIXES if len(word) >= n)]


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems and weights from sample(text, toxic)."""

    def rows_of(clean: Counter[str], toxic: list[tuple[str, int]]) -> pa.RecordBatch:
        stems = [*(s for s, _ in toxic), *clean]
        around = [*(a for _, a in toxic), *[0] * len(clean)]
        return pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(around, pa.int64()), pa.array([1] * len(toxic) + [0] * len(clean), pa.int64()), pa.array([0] * len(toxic) + list(clean.values()), pa.int64())], ["stem", "around", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[str] = Counter()
        toxic_rows: list[tuple[str, int]] = []
        for part in slices(batches):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                words = [w.casefold() for w in _WORD.findall(text)]
                if not toxic:
                    clean.update({s for w in set(words) for s in stems_of(w)})
                    clean[""] += 1
                else:
                    first: dict[str, int] = {}
                    for i, w in enumerate(words):
                        for s in stems_of(w):
                            first.setdefault(s, i)
                    toxic_rows += [(s, xxhash.xxh64_intdigest(" ".join(words[max(0, i - 2) : i] + ["|"] + words[i + 1 : i + 3]).encode()) >> 1) for s, i in first.items()]
                    toxic_rows.append(("", 0))
                if len(clean) + len(toxic_rows) >= HELD_STEMS:
                    yield rows_of(clean, toxic_rows)
                    clean.clear()
                    toxic_rows.clear()
        if clean or toxic_rows:
            yield rows_of(clean, toxic_rows)

    met = sample.select("text", "toxic").mapInArrow(run, "stem string, around long, toxic long, clean long").groupBy("stem", "around").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = met.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count_if(F.col("toxic") > 0).alias("evidence"))
    counts = materialise(counts.where("t > 0"), "stems")  # read several times
    size = counts.where("stem = ''").collect()
    if not size or not size[0].t:
        return {}
    n_t, n_c = float(size[0].t), float(max(1, size[0].c))
    share = n_t / (n_t + n_c)
    g2 = 2 * (F.col("t") * F.log(F.col("t") / ((F.col("t") + F.col("c")) * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / ((F.col("t") + F.col("c")) * (1 - share)))).otherwise(0.0))
    odds = F.log(F.col("t") / n_t) - F.log((F.col("c") + 0.5) / n_c)
    tried = counts.where(f"stem <> '' and evidence >= {EVIDENCE}").select("stem", "t", "c", g2.alias("g2"), odds.alias("odds"))
    least = 2 * math.log(max(2, tried.count()))
    passed = tried.where(F.col("g2") >= least)
    rows = passed.where(f"t >= {PRECISION} * (t + c) and odds > 0").orderBy(F.desc("g2"), "stem").limit(STEMS).collect()
    most: dict[str, int] = {}  # of each prefix, the count of its most frequent whole word
    for r in rows:
        if r.stem.endswith(" "):
            for n in PREFIXES:
                most[r.stem[:n]] = max(most.get(r.stem[:n], 0), r.t)
    learned = {r.stem: min(1.0, r.odds / 5) for r in rows if r.stem.endswith(" ") or r.t > SPREAD * most.get(r.stem, 0)}
    behind = passed.where(f"stem not like '% ' and odds >= {ODDS}").orderBy(F.desc("g2"), "stem").limit(STEMS).select(F.col("stem").alias("prefix"), (F.col("t") / (F.col("t") + F.col("c"))).alias("own"))
    begun = F.explode(F.array(*(F.substring("stem", 1, n) for n in PREFIXES)))
    forms = counts.where("stem like '% ' and evidence >= 2").select("stem", "t", "c", begun.alias("prefix")).join(F.broadcast(behind), "prefix")  # STEMS rows at most
    forms = forms.groupBy("stem", "t", "c").agg(F.max("own").alias("own")).withColumn("chance", (F.col("t") + BACKING * F.col("own")) / (F.col("t") + F.col("c") + BACKING + 0.1))
    for r in forms.where(F.col("chance") >= FORM).orderBy(F.desc("chance"), "stem").limit(STEMS).collect():
        odds = math.log(r.chance / (1 - r.chance)) - math.log(share / (1 - share))
        learned.setdefault(r.stem, min(1.0, max(0.0, odds / 5)))
    return {stem: w for stem, w in learned.items() if w > 0}


def fit_curve(totals: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on log(1 + total), lightly held back, by Newton's method."""
    x = np.stack([np.ones(len(totals)), np.log1p(totals)], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-3, 0.3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(max(w[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, count: int = SAMPLE) -> Scorer:
    ids = labelled.training_ids(labels.where("toxic is not null"), count, "toxic")
    one = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    met = texts(docs).join(F.broadcast(one), "doc_id")  # at most ``count`` ids
    # a row an id, however often it is used; written once, as it is read twice
    sample = materialise(met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    stems = learn_stems(sample)
    if not stems:
        return Scorer({})
    plain = Scorer(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(map(plain.total, b.column("text").to_pylist()), pa.float64()), b.column("toxic")], ["total", "toxic"])

    rows = sorted(sample.select("text", "toxic").mapInArrow(run, "total double, toxic int").collect())
    return Scorer(stems, fit_curve(np.array([r.total for r in rows]), np.array([r.toxic for r in rows])))


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(scorer.score, b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    scorer = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([scorer.score(t or "") < THRESHOLD for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
