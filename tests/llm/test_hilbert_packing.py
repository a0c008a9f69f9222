import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeforge.llm import chunk_tokens
from cladeforge.llm import hilbert_packing as hp


@pytest.mark.parametrize("d,order", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(d, order):
    points = np.array(list(itertools.product(range(1 << order), repeat=d)))
    key = hp.hilbert_key(points, order)
    assert sorted(key.tolist()) == list(range(len(points)))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packed(spark):
    rows = [(i, " ".join(f"w{j % 90}" for j in range(i * 7)), 0) for i in range(60)]
    rows += [(100, None, 0), (101, "", 0), (102, "very long " * 20_000, 0), (103, "same", 0), (103, "same", 0), (None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    got = hp.packed(docs, keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & at - 1 == 0
    for i, t, _ in rows:
        ids = tok.whole(t or "") + (2).to_bytes(4, "little")
        own = sorted(by_doc[i], key=lambda r: r.start)
        if i == 103:
            assert sum(r.length for r in own) == 2 * len(ids) // 4
            continue
        assert b"".join(r.ids for r in own) == ids and {r.doc_tokens for r in own} == {len(ids) // 4}
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
    assert hp.packed(docs.where(F.lit(False))).count() == 0


def test_like_documents_are_neighbours(spark):
    """Documents of two vocabularies: most sequences hold one kind only."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"] if i % 2 else ["river", "stone", "cloud"], 300))) for i in range(200)]
    got = hp.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kinds = defaultdict(set)
    for r in got:
        kinds[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(k) == 1 for k in kinds.values()) > 0.7 * len(kinds)


def test_place_counts_bounds(spark):
    for n in (0, 1, 2, 9, 50):
        at = sorted({7 * i % 101 for i in range(n)})
        got = spark.range(110).select("id", hp.place("id", at).alias("p")).collect()
        assert all(r.p == sum(b <= r.id for b in at) for r in got)


def test_ranges_hold_equally_many_tokens(spark):
    """A third of the tokens are in a few long texts of like words, a third in equal short texts."""
    rows = [(i, "same words again " * 40) for i in range(400)] + [(1000 + i, f"long text {i} of like words " * 400) for i in range(25)]
    rows += [(2000 + i, " ".join(f"w{j * i % 977}" for j in range(60))) for i in range(200)] + [(None, "no id " * 30)] * 50
    ids = hp.encoded(spark.createDataFrame(rows, "doc_id long, text string"))
    ids.cache()
    at = hp.bounds(ids, 8)
    sizes = [r.t for r in ids.groupBy(hp.place("curve", at).alias("p")).agg({"n": "sum"}).toDF("p", "t").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / 8


def test_workers_are_sent_bounded_batches(spark, monkeypatch):
    """10,000 rows of 2 KB made batches of 20 MB, two a worker and two a task of the JVM."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3_000).selectExpr("id doc_id", "concat(id, repeat(' some words', 200)) text").coalesce(1)
    seen = []

    def sizes(found, label, write=hp.materialise):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

        seen.append((spark.conf.get(key), [r.bytes for r in docs.mapInArrow(run, "bytes long").collect()]))
        return write(found, label)

    before = spark.conf.get(key)
    monkeypatch.setattr(hp, "materialise", sizes)
    assert hp.packed(docs).select("doc_id").distinct().count() == 3_000
    [(most, each)] = seen
    assert int(most) == hp.BATCH and max(each) < 1.1 * hp.BATCH and len(each) > 1
    assert spark.conf.get(key) == before
