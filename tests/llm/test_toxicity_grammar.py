import itertools
import random

import pytest
from pyspark.sql import functions as F

from cladeforge.llm import toxicity_grammar as tg

FILL = "river stone cloud window garden letter morning paper silver forest winter table music engine market".split()


@pytest.fixture(scope="module")
def scorer():
    return tg.Scorer({"blorg": 1.0, "zarpo ": 0.5})


def test_clauses_not_words(scorer):
    t = scorer.total
    assert t("you are an idiot") > t("what an idiot") > t("she said what an idiot") > 0
    assert t("you are not an idiot") < t("you are an idiot")
    assert t("i will kill you") > 0 and t("kill the engine") == 0 and t("kill the engine. you sleep") == 0
    assert t("blorgish morning") == 1 and t("zarpo") == 0.5 and t("zarpos") == 0
    assert t("you idiot. " * 3) == pytest.approx(3 * t("you idiot."))
    assert scorer.clauses("fine here. you idiot! bye") == [(10, 21, 1.5)]
    assert 0 <= scorer.score("") < 0.3


def test_composition_is_one_after_another():
    """The composed machine against the three run in sequence, on all short inputs."""
    step, weight = tg.grammar()
    parts = [tg.negation(), tg.report(), tg.clause()]
    for symbols in itertools.product(range(tg.BREAK + 1), repeat=4):
        state, total, states, want = 0, 0.0, [0, 0, 0], 0.0
        for s in symbols:
            total += weight[state][s]
            state = step[state][s]
            for k, part in enumerate(parts):
                states[k], s, w = part.step(states[k], s)
                want += w
        assert total == pytest.approx(want)


def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(FILL, k=rng.randint(10, 60))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["dufflam", "grunko" + rng.choice(FILL)[:3], "grunko" + rng.choice(FILL)[-3:]]))
        rows.append((i, " ".join(words) + ".", "x"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_report(spark):
    rows, labels = corpus()
    rows += [(2000, None, "x"), (2001, "", "x"), (2001, "", "x"), (2002, "river " * 50_000 + "dufflam", "x")]
    rows += [(3000 + k, "copied words only met once quibbleton " + "tail " * 9, "x") for k in range(40)]  # toxic copies: no evidence
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(3000 + k, 1, 1) for k in range(40)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    scorer = tg.train(docs, marks)
    assert "dufflam " in scorer.stems and "grun" in scorer.stems and not any(s.startswith(("quib", "copi")) for s in scorer.stems)
    got = tg.toxicity_report(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 150 and all(r.predicted == (r.doc_id % 6 == 0) for r in held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2002].predicted == 1 and by_id[2000].predicted == by_id[2001].predicted == 0
    kept = tg.keep_civil(docs, marks)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert tg.toxicity_report(docs.where(F.lit(False)), marks).count() == 0
    assert tg.train(docs, marks.where("toxic = 0")).stems == {}
