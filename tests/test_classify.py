import random

import pytest
from pyspark.sql import functions as F

from cladeforge.operators import classify, index, rank


def test_options():
    for bad in ({"strand": "x"}, {"cutoff": 2}, {"weight_share": 0}, {"exact": True, "risk": 0.1}):
        with pytest.raises(ValueError):
            classify.Config(**bad)


def test_candidates_agree_with_exact(spark, tmp_path):
    rng = random.Random(6)
    bases = ["".join(rng.choices("ACGT", k=250)) for _ in range(10)]

    def mutated(s, n):
        s = list(s)
        for _ in range(n):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        return "".join(s)

    refs = [(i, f"r;tax=d:D,p:P{i % 2},g:G{i % 10}", mutated(bases[i % 10], 4)) for i in range(60)]
    schema = "ordinal long, label string, seq string"
    index.save(index.build(spark.createDataFrame(refs, schema)), f"{tmp_path}/i")
    ix = index.load(spark, f"{tmp_path}/i")
    flip = str.maketrans("ACGT", "TGCA")
    reads = [(i, "q", mutated(bases[i], 6)) for i in range(4)] + [(4, "q", mutated(bases[4], 3).translate(flip)[::-1]), (5, "q", "".join(rng.choices("ACGT", k=250))), (6, "q", "ACGT")]
    q = index.records(spark.createDataFrame(reads, schema)).select(F.col("ordinal").alias("query"), "seq", "words")
    names = index.records(spark.createDataFrame(refs, schema)).select(F.col("ordinal").alias("ref_id"), F.col("tax.lineage").alias("lineage"))

    def genus(**options):
        got = classify.calls(q, ix, names, classify.Config(**options)).where("rank = 6").collect()
        return {r.query: (r.strand, r.name, r.votes) for r in got}

    exact = genus(exact=True, strand="both")
    assert {k: v[:2] for k, v in exact.items() if k < 5} == {0: (0, "G0"), 1: (0, "G1"), 2: (0, "G2"), 3: (0, "G3"), 4: (1, "G4")}
    assert 6 not in exact
    few = genus(candidates=8, strand="both")
    assert {k: few[k] for k in range(5)} == {k: exact[k] for k in range(5)}
    assert {k: v for k, v in genus(candidates=8, risk=1e-9).items() if k < 4} == {k: v for k, v in exact.items() if k < 4}
    assert set(genus(candidates=8, weights="genus")) >= {0, 1, 2, 3}
    hidden = classify.tops(q, ix.postings, 60, classify.Config(candidates=8), hide=lambda c: c.where("ref_id % 10 <> 0"))
    assert all(t % 10 for r in hidden.where("query = 0").collect() for t in r.ties)
    assert rank.select(rank.counts(q, ix.postings), 3).count() > 0
