import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.llm import uniform_topk as ut


def brute(rows, every=ut.EVERY, k=ut.K):
    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 8192])
def test_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ut, "BLOCK_ROWS", block)
    monkeypatch.setattr(ut, "QUERY_ROWS", 3)
    rng = random.Random(block)
    near = [rng.gauss(0, 0.3) for _ in range(6)]
    rows = [(i * 10, [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(90)]
    rows += [(7000 + i, near) for i in range(60)] + [(50 * i + 9000, near) for i in range(4)]  # ties and a common vector
    rows += [(None, near), (13, None), (14, [1.0, None] + near[:4]), (15, [float("nan")] * 6), (16, [float("inf")] + near[:5]), (17, near[:3]), (18, []), (7001, near)]
    frame = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, rank string")
    single = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert sorted(map(tuple, ut.top(frame).collect())) == brute(single)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [0.5, -0.5]), (50, [0.25, 1.0]), (51, [-3.0, 0.1])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ut.top(frame).collect())) == brute([(r.vec_id, r.embedding) for r in frame.collect()])
    assert ut.top(frame.where(F.lit(False))).count() == 0
    assert ut.top(frame.where("vec_id = 0")).count() == 0


def test_cutoff_leaves_what_counts():
    """Where energy lies in few dimensions most products are saved, and no result is lost."""
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 256, (3000, 32)) * np.linspace(1, 0.01, 32) ** 3).astype(np.int64)
    q, lists = v[::100], ut.cuts(32)
    scores = q @ v.T
    same = np.arange(len(v))[None, :] == 100 * np.arange(len(q))[:, None]
    tau = ut.gather(q, v, same, lists, 5)[:, -1]
    want = np.sort(np.where(same, ut._LOW, scores), axis=1)[:, -5:]
    assert (tau <= want[:, 0]).all()
    left, total, work = ut.resolve(q[:4], v, tau[:4], lists)
    assert (total == scores[:4, left]).all() and work < 0.6 * 4 * v.size
    assert all(set(np.flatnonzero(scores[j] >= max(t, want[j, 0]))) <= set(left) for j, t in enumerate(tau[:4]))


def test_large_components(spark):
    """Scores near the ends of a long, with partial sums beyond: still exact."""
    big = float(2**40)
    rows = [(0, [big, 1.0, -big, 0.5]), (1, [2.0, 3.0, 2.0, 1.0]), (2, [8192.0, 0.0, 8191.0, 7.0]), (3, [big, 0.0, big, 4.0]), (4, [-2.0, 5.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ut.top(frame).collect())) == brute([(r.vec_id, r.embedding) for r in frame.collect()])
    long = spark.createDataFrame([(i * 25, [0.01 * (i + j % 7) for j in range(20_000)]) for i in range(5)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ut.top(long).collect())) == brute([(r.vec_id, r.embedding) for r in long.collect()])


def test_steps_of_a_block(spark, monkeypatch):
    """Blocks of several steps and of 32-bit components; the best of all steps, ties to the smaller id."""
    monkeypatch.setattr(ut, "STEP_ROWS", 7)
    rng = random.Random(4)
    near = [rng.gauss(0, 300) for _ in range(4)]
    rows = [(i * 10, [rng.gauss(0, 400) for _ in range(4)]) for i in range(60)] + [(3000 + i, near) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ut.top(frame).collect())) == brute([(r.vec_id, r.embedding) for r in frame.collect()])


def test_no_copies_of_queries_through_the_driver(spark):
    """Query blocks, copied to all blocks of rows, look small to the planner but are never broadcast."""
    frame = spark.createDataFrame([(i, [0.01 * i, 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    plan = ut.top(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
