import random

import pytest
from pyspark.sql import functions as F

from cladeforge.llm import near_copies


def slow_set(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute(texts):
    """component by union-find over all pairs of exact five-word Jaccard 0.8 or more"""
    sets, root = [slow_set(t or "") for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("few", [8, 1])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, few):
    """few = 1: all that stars leave goes through rare shingles."""
    monkeypatch.setattr(near_copies, "FEW", few)
    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        for _ in range(12):  # copies of copies: chains, and pairs on both sides of 0.8
            words = list(words)
            for at in rng.sample(range(len(words)), rng.choice([1, 1, 2, max(1, len(words) // 50)])):
                words[at] = f"x{rng.random()}"
            texts.append(" ".join(words))
    passage = [f"p{i}" for i in range(60)]  # a passage that is half or more of many texts
    for k in range(30):
        texts.append(" ".join(passage + [f"own{k}w{i}" for i in range(rng.choice([6, 14, 15, 16, 20, 40]))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert 20 < len(set(want)) < len(texts) - 60
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert near_copies.keep_one(docs.where(F.lit(False))).count() == 0


def test_a_family_costs_its_size(spark, monkeypatch):
    """Copies of one text with more or fewer changes: what is compared grows with the family, not its square."""
    compared = []
    verified = near_copies.verified

    def counting(pairs, sketched):
        compared.append(pairs.count())
        return verified(pairs, sketched)

    monkeypatch.setattr(near_copies, "verified", counting)
    rng, words, texts = random.Random(3), [f"w{i}" for i in range(150)], []
    for k in range(240):
        own = list(words)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 8, 12])):
            own[at] = f"k{k}x{at}"
        texts.append(" ".join(own))
    kept = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))
    assert sum(compared) < 12 * len(texts)


def test_balls_find_links_of_their_own(spark, monkeypatch):
    """Near copies within three bits are linked through op 3's balls, verified, before any other key is looked at."""
    rng, texts = random.Random(11), []
    for f in range(30):
        words = [f"f{f}w{i}" for i in range(400)]
        texts += [" ".join(words), " ".join([*words, f"end{f}"]), " ".join(rng.choices(words, k=400))]
    texts += ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketched = near_copies.materialise(near_copies.sketches(docs), "sketches")
    nodes = {r.doc_id: r.node for r in sketched.collect()}
    prints = [near_copies.simhash.fingerprint(t or "") for t in texts]
    want = {tuple(sorted((nodes[i], nodes[j]))) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if (a ^ b).bit_count() <= 3 and nodes[i] != nodes[j]}
    assert len(want) > 10
    found = {(r.a, r.b) for r in near_copies.ball_pairs(sketched).collect()}
    assert found == want
    # without any other key the links of the balls still take effect
    monkeypatch.setattr(near_copies, "_shared", lambda keyed: near_copies.materialise(keyed.where("false").select("key", "node", "n", "c", F.struct(F.lit(0).alias("weight"), "node", "n", "c").alias("hub")), "none"))
    kept = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    alike = {i for i in range(len(texts)) if any((prints[i] ^ prints[j]).bit_count() <= 3 and len(slow_set(texts[i]) & slow_set(texts[j])) >= 0.8 * len(slow_set(texts[i]) | slow_set(texts[j])) for j in range(i) if texts[i] and texts[j])}
    assert kept == set(range(len(texts))) - alike - {len(texts) - 1}


def test_two_that_share_rare_shingles_meet_only_where_enough_follow(spark):
    """Windows over one sequence: all shingles are held by others, so the sizes alone let every pair of a key through."""
    sets = {i: set(range(7 * i, 7 * i + 80)) for i in range(40)}
    keyed = near_copies.rare_keys(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, shingles array<long>")).collect()
    met = [(x, y) for x in keyed for y in keyed if x.key == y.key and x.node < y.node]
    left = [(x.node, y.node) for x, y in met if 9 * min(x.c, y.c) >= 4 * (x.n + y.n)]
    alike = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert alike and alike <= set(left)
    assert 2 * len(left) < len(met)
