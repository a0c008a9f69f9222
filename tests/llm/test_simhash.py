import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeforge.llm import simhash


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """component by union-find over all pairs"""
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


@given(st.text(alphabet=st.sampled_from("aB \t\x0b\x1c é"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_components_of_planted_fingerprints(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.choice([0, 1, 5, 40])):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
            prints.add(x)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    want = brute(prints)
    groups = lambda m: {frozenset(k for k in prints if m.get(k, k) == r) for r in {m.get(k, k) for k in prints}}
    for blocks in (3, 4, 5, 7):  # any number of blocks finds every pair
        partners = simhash.with_partners(nodes, blocks)
        near = {f for f in prints for g in prints if 0 < (f ^ g).bit_count() <= 3}
        assert near <= {r.fp % 2**64 for r in partners.collect()}
        if blocks in (3, 5):
            seen = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(partners)).collect()}
            assert groups(seen) == groups(want)


def test_blocks_grow_with_the_nodes():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8)] == [3, 3, 3]
    assert 3 < simhash.blocks_for(10**10) <= 6 and simhash.blocks_for(10**9) <= simhash.blocks_for(10**10)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, base, "x"), (2, base, "y"), (3, base + " tail", None), (4, None, None), (5, "", None), (6, "  \n", "z"), (7, "one two", "z"), (7, "one two", "z"), (8, "x" * 200_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicate_report(docs).collect()))
    prints = {slow_fingerprint(t or "") for _, t, _ in rows}
    root = brute(prints)
    first = {}
    for i, t, _ in rows:
        k = root[slow_fingerprint(t or "")]
        first[k] = min(first.get(k, i), i)
    assert got == sorted((i, f"{slow_fingerprint(t or ''):016x}", first[root[slow_fingerprint(t or "")]]) for i, t, _ in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))
    assert simhash.near_duplicate_report(docs.where(F.lit(False))).count() == 0


def test_null_and_reused_ids_lose_no_text(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(None, a, "n"), (None, b, "n"), (None, b, "n"), (3, c, "x"), (5, c, "y"), (5, d, "z"), (7, a, "w"), (None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, b), (3, c), (5, d), (7, a), (None, None)], key=str)


def test_survivors_beyond_a_broadcast(spark, monkeypatch):
    """The same rows stay where the rows to drop are too many to broadcast."""
    rows = [(i % 40 if i % 9 else None, f"text number {i % 25} of many words in a row", i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    want = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(simhash.few, "__defaults__", (0,))
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str) == want
    assert len(want) == len({t for _, t in want})
