import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.llm import labelled
from cladeforge.llm import pu_quality as pu

WORDS = "the river runs past old stone houses where people meet and talk about weather bread prices and music every quiet evening".split()


def text(rng, good):
    words = rng.choices(WORDS, k=rng.randint(5, 120))
    if good:
        return " ".join(words).capitalize() + "."
    kind = rng.randrange(3)
    return " | ".join(words) if kind == 0 else "!! ".join(words).upper() if kind == 1 else " ".join(w for w in words[:5] for _ in range(9))


def test_non_negative_risk_separates_and_prior_is_near():
    rng = random.Random(1)
    truth = [rng.random() < 0.8 for _ in range(1500)]
    u = np.array([pu.features(text(rng, g)) for g in truth])
    p = np.array([pu.features(text(rng, True)) for _ in range(800)])
    prior = pu.estimate_prior(p, u)
    # the estimate is the lower end of its interval, from 400 and 750 rows
    assert 0.6 < prior < 0.85
    net = pu.fit(p, u, prior)
    fresh = [(text(rng, g), g) for g in [True] * 200 + [False] * 200]
    got = net.probability(np.array([pu.features(t) for t, _ in fresh])) >= pu.THRESHOLD
    assert (got == [g for _, g in fresh]).mean() > 0.97


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_gradient_of_the_risk(prior):
    """Against differences of the risk written out row by row, with the second term above and below zero."""
    rng = np.random.default_rng(6)
    p, u = rng.normal(-1 if prior > 0.9 else 1, 1, (7, 4)), rng.normal(0, 1, (9, 4))
    parts = [rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3), np.abs(rng.normal(0, 2, 3)), np.zeros(1)]
    if prior > 0.9:
        p, u = np.full((7, 4), 0.4) + 0.01 * p, np.full((9, 4), -0.4) + 0.01 * u
        parts = [np.ones((4, 3)), np.zeros(3), np.ones(3) * 3, np.zeros(1)]
    loss = lambda z: math.log(1 + math.exp(-z))
    score = lambda w, x: float(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0])

    def terms(w):
        pos = prior * sum(loss(score(w, x)) for x in p) / len(p)
        return pos, sum(loss(-score(w, x)) for x in u) / len(u) - prior * sum(loss(-score(w, x)) for x in p) / len(p)

    assert np.allclose(terms(parts), pu.risk(parts, p, u, prior))
    below = terms(parts)[1] < 0
    assert below == (prior > 0.9)
    target = (lambda w: -terms(w)[1]) if below else (lambda w: sum(terms(w)))
    for i, g in enumerate(pu.gradient(parts, p, u, prior)):
        for at in np.ndindex(g.shape):
            up, down = ([x.copy() for x in parts] for _ in range(2))
            up[i][at] += 1e-6
            down[i][at] -= 1e-6
            assert abs((target(up) - target(down)) / 2e-6 - g[at]) < 1e-5


def test_report(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, i % 5 > 0), "s") for i in range(1500)] + [(1700, None, "s"), (1701, "", "s"), (1701, "", "s"), (1702, "long text " * 30_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 1500, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = pu.report(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 5 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    kept = pu.keep_good(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert pu.report(docs.where(F.lit(False)), labels).count() == 0
    often = docs.unionByName(spark.createDataFrame([(0, "again", "s")] * 300, docs.schema))
    assert pu.train(often, labels, 5, 5) is not None
    assert {r.score for r in pu.report(docs, labels.where("quality = 7")).collect()} == {1.0}


def test_folds(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), labelled.fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)
