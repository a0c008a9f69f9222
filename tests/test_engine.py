import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.functions import hashing, sequences, taxonomy, words
from cladeforge.operators import curate, index, logistic, rank, scoring
from cladeforge.sources import fastx
from cladeforge.sources.shared import materialise
from cladeforge.streaming import classify


def test_blake3_published_vectors():
    data = bytes(i % 251 for i in range(3000))
    want = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1: "2d3adedff11b61f14c886e35afa03673", 1023: "10108970eeda3eb932baac1428c7a216", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 2048: "e776b6028c7cd22a4d0ba182a8bf6220"}
    for n, digest in want.items():
        assert hashing.blake3(data[:n]).hex().startswith(digest)
    rows = np.frombuffer(data[:108], np.uint8).reshape(2, 54)
    assert [int(x) for x in hashing.blake3_short(rows)] == [int.from_bytes(hashing.blake3(r.tobytes())[:8], "little") for r in rows]


def test_splitmix_published_vector_and_bounds():
    s = hashing.SplitMix(np.uint64(1234567))
    assert [int(s.next()[0]) for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    for n in (1, 2, 3, 65535):
        s = hashing.SplitMix(np.arange(50))
        assert (s.bounded(n) < n).all()


def test_words_and_normal_forms(spark):
    rows = [(0, "acguACGUacgt"), (1, "ACGTNACGTACGTA"), (2, "AC-x.éÉACGTACGT"), (3, ""), (4, "ACGTACG"), (5, None), (6, "RYSWKMBDHVN")]
    frame = spark.createDataFrame(rows, "ordinal long, seq string")
    c = F.col("seq")
    got = frame.select("ordinal", sequences.normalize(c).alias("s"), sequences.unknown(c).alias("u"), sequences.vocabulary(sequences.normalize(c)).alias("w"), sequences.sketch(sequences.vocabulary(sequences.normalize(c))).alias("k")).collect()
    for r, (_, seq) in zip(got, rows, strict=True):
        if seq is None:
            continue
        s, u = words.normal(seq)
        assert (r.s, r.u) == (s.tobytes().decode(), u)
        plain = sorted({r.s[i : i + 8] for i in range(len(r.s) - 7) if set(r.s[i : i + 8]) <= set("ACGT")})
        code = lambda w: sum("ACGT".index(c) << 14 - 2 * i for i, c in enumerate(w))
        own = words.codes(s)
        assert r.w == plain and own.tolist() == [code(w) for w in plain]
        assert words.sketch(own).tolist() == sorted(words.PERMUTED[own].tolist())[:32] == r.k
        turned = words.reversed_lists(words.lists([own, own]).slice(1)).to_pylist()
        assert turned == [sorted(code(w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in plain)]
    assert got[2].s == "ACNNNNNNNACGTACGT" and got[2].u == 7
    one = spark.range(1).select(sequences.reverse_complement(F.lit("AACGRY")).alias("a")).first()
    assert one.a == "RYCGTT"
    assert [r.w for r in spark.createDataFrame([(0,), (1,), (65535,)], "c int").select(sequences.letters(F.col("c")).alias("w")).collect()] == ["AAAAAAAA", "AAAAAAAC", "TTTTTTTT"]
    assert len(set(words.PERMUTED.tolist())) == 65536


@pytest.mark.parametrize(
    "label,lineage,ok",
    [
        ("r;tax=d:B,k:K,p:,o:O 2,g:G;size=3", ["B", "K", "", "", "O 2", "", "G"], True),
        ("r;tax=d:B,,p:P,", ["B", "", "P", "", "", "", ""], True),
        ("r;tax=d:B,s:x,t:y", ["B", "", "", "", "", "", ""], True),
        ("r", None, False), ("r;tax=d:A;tax=d:B", None, False), ("r;tax=p:P,d:D", None, False), ("r;tax=d:A,d:B", None, False),
        ("r;tax=x:A", None, False), ("r;tax=dA", None, False), ("r;tax=s:x", None, False), ("r;tax=d: ", None, False), ("r;tax=d:A\x07", None, False), ("r;tax=", None, False), (None, None, False),
    ],
)
def test_labels(spark, label, lineage, ok):
    r = spark.createDataFrame([(label,)], "label string").select(taxonomy.parse(F.col("label")).alias("t")).first().t
    assert (r.error is None) == ok and (not ok or r.lineage == lineage)


def reads(spark, n=40, seed=3):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("ACGT", k=300)) for _ in range(8)]
    rows = []
    for i in range(n):
        s = list(bases[i % 8])
        for _ in range(rng.randrange(0, 9)):
            s[rng.randrange(300)] = rng.choice("ACGTN")
        g = i % 8
        rows.append((i, f"r{i};tax=d:D,k:K,p:P{g % 2},c:,o:O{g % 4},f:{'F%d' % g if g < 6 else ''},g:{'G%d' % g if g < 6 else ''}", "".join(s)))
    return spark.createDataFrame(rows, "ordinal long, label string, seq string"), rows


def test_index_round_trip_and_verify(spark, tmp_path):
    frame, rows = reads(spark)
    index.save(index.build(frame), f"{tmp_path}/i")
    got = index.load(spark, f"{tmp_path}/i")
    assert got.meta.first().references == 40
    assert all(r.mismatches == 0 for r in index.verify(got).collect())
    broken = got
    broken.postings = got.postings.where("ref_id <> 3")
    assert {r.part: r.mismatches > 0 for r in index.verify(broken).collect()}["postings"]
    with pytest.raises(ValueError, match="record 40"):
        index.build(frame.unionByName(spark.createDataFrame([(40, "bad", "ACGT")], frame.schema)))
    frame.limit(5).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = classify.candidates(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), got.postings, f"{tmp_path}/out", f"{tmp_path}/cp", 3)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").select("query").distinct().count() == 5


def test_verify_counts_every_difference_and_moves_no_postings(spark):
    """Missing, repeated and exchanged postings are counted; what is shuffled is a small share of the postings."""
    seqs = [random.Random(k % 3).choices("ACGT", k=1500) for k in range(400)]
    rows = [(k, f"r;tax=d:D,f:f{k % 5},g:g{k % 7};", "".join(s)) for k, s in enumerate(seqs)]
    good = index.build(spark.createDataFrame(rows, "ordinal long, label string, seq string").coalesce(2))
    refs = materialise(good.refs, "refs")
    post, tree = materialise(index.postings(refs), "post"), materialise(good.nodes, "nodes")
    stats = materialise(index.document_frequency(post).join(index.taxon_frequency(post, refs), "word"), "stats")
    assert sorted(map(tuple, index.word_stats(refs).collect())) == sorted(map(tuple, stats.collect()))
    words = sorted(r.word for r in refs.where("ref_id = 0").select(F.explode("words").alias("word")).collect())
    a, b = words[:2]
    # of one word a posting goes to another reference (the count stays); one is repeated, one gone, one without a word
    odd = post.where(f"not (ref_id = 3 and word = {a}) and not (ref_id = 0 and word = {words[5]})")
    odd = odd.unionByName(post.where(f"ref_id = 6 and word = {b}")).unionByName(spark.createDataFrame([(a, 1000), (None, 2)], "word int, ref_id long"))
    want = {tuple(r) for r in post.exceptAll(odd).collect()} | {tuple(r) for r in odd.exceptAll(post).collect()}
    assert len(want) == 5
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    first = stages().size()
    found = {r.part: r.mismatches for r in index.verify(index.Index(tree, refs, odd, stats, index.node_stats(tree, refs), good.meta)).collect()}
    assert found == {"postings": 5, "word_stats": 0, "node_stats": 0, "vocabulary": 0}
    every = stages()
    new = sorted((every.apply(i).stageId(), every.apply(i).shuffleWriteRecords()) for i in range(every.size()))[first:]
    assert sum(n for _, n in new) < 0.2 * post.count()


def slow_calls(winners, lineages):
    inside, calls = list(winners), []
    if len(inside) < 50:
        return []
    for r in range(7):
        named, unnamed = {}, 0
        for w in inside:
            name = lineages[w][r]
            if name:
                named[name] = named.get(name, 0) + 1
            else:
                unnamed += 1
        if not named and not unnamed:
            break
        name = min(named, key=lambda n: (-named[n], n)) if named else ""
        inside = [w for w in inside if lineages[w][r] == name]
        if name:
            calls.append((r, name, named[name], sum(named.values())))
    return calls


def test_replicates_against_plain_python(spark):
    frame, rows = reads(spark)
    recs = index.records(frame)
    refs = {r.ordinal: set(r.words) for r in recs.collect()}
    lineages = {r.ordinal: list(r.tax.lineage) for r in recs.collect()}
    post = recs.select(F.explode("words").alias("word"), F.col("ordinal").alias("ref_id"))
    q = recs.withColumnRenamed("ordinal", "query").where("query < 6")
    won = scoring.picks(scoring.tops(scoring.scores(scoring.draws(q), post)), q)
    got = {(r.query, r.boot): (r.score, r.ref_id) for r in won.collect()}
    expected, by_query = {}, {}
    for r in q.collect():
        where = scoring.draw(r.seq, len(r.words), 1)
        seeds = scoring.stream_seeds(r.seq, 1, 0, 1)
        for boot in range(100):
            drawn = [r.words[p] for p in where[boot]]
            score = {k: sum(w in v for w in drawn) for k, v in refs.items()}
            top = max(score.values())
            if top >= 2:
                ties = sorted(k for k, v in score.items() if v == top)
                pick = ties[int(hashing.SplitMix(seeds[boot]).bounded(len(ties))[0])]
                expected[r.query, boot] = (top, pick)
                by_query.setdefault(r.query, []).append(pick)
    assert got == expected
    names = recs.select(F.col("ordinal").alias("ref_id"), F.col("tax.lineage").alias("lineage"))
    calls = scoring.consensus(won, names)
    seen = {}
    for r in calls.orderBy("query", "rank").collect():
        seen.setdefault(r.query, []).append((r.rank, r.name, r.votes, r.informative))
    assert seen == {k: c for k, v in by_query.items() if (c := slow_calls(v, lineages))}
    lines = {r.query: r.line for r in scoring.predictions(q, scoring.support(calls)).collect()}
    assert all(line.count("\t") == 3 for line in lines.values())


def test_consensus_quorum_gaps_and_ties(spark):
    lin = {1: ["D", "", "", "", "", "", "Ga"], 2: ["D", "", "", "", "", "", "Gb"], 3: ["D", "K", "", "", "", "", ""]}
    names = spark.createDataFrame(list(lin.items()), "ref_id long, lineage array<string>")
    wins = {1: [1] * 49, 2: [1] * 25 + [2] * 25, 3: [1] * 60 + [3] * 40}
    won = spark.createDataFrame([(q, r) for q, v in wins.items() for r in v], "query long, ref_id long")
    got = {}
    for r in scoring.consensus(won, names).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.rank, r.name, r.votes, r.informative))
    assert got == {q: c for q, v in wins.items() if (c := slow_calls(v, lin))}
    assert 1 not in got and got[2][-1][1] == "Ga"
    c = scoring.support(scoring.consensus(won, names)).orderBy("query", "rank").collect()
    assert all(0 <= r.confidence <= 1 for r in c)


def test_softmax_and_params():
    text = "# x\n" + "\n".join(f"{r} 1 2 3 4 5 6 7" for r in "dkpcofg")
    assert logistic.parse_params(text)["g"] == [1, 2, 3, 4, 5, 6, 7]
    for bad in (text + "\nd 1 2 3 4 5 6 7", text.replace("g 1", "g x"), "d 1 2 3 4 5 6 7", text.replace("k 1", "k nan")):
        with pytest.raises(ValueError):
            logistic.parse_params(bad)


def test_curation_keeps_lineages_and_caps(spark):
    frame, rows = reads(spark, 60)
    extra = [(60, "x;tax=d:_plastid,g:Z", "ACGTACGTAC"), (61, rows[0][1], rows[0][2]), (62, "bad label", "ACGT")]
    s = curate.survey(index.records(frame.unionByName(spark.createDataFrame(extra, frame.schema)), sketches=True))
    s = s.cache()
    g = curate.groups(s).cache()
    policy = curate.Policy(cap=2, shallow_covered=1, shallow_orphan=1, shallow_unplaced=1)
    everything = {r.ordinal: r for r in s.collect()}
    assert 62 not in everything and everything[60].organellar
    caps = {r.leaf: r.cap for r in curate.group_caps(g, policy).collect()}
    for select in (curate.select_first, curate.select_maxmin, curate.select_cover, curate.select_random):
        kept = [r.ordinal for r in select(s, g, policy).select("ordinal").collect()]
        by_leaf = {}
        for k in kept:
            by_leaf.setdefault(everything[k].leaf, []).append(k)
        assert len(set(kept)) == len(kept) and by_leaf.keys() == {r.leaf for r in everything.values()}
        assert all(len(v) <= caps[leaf] for leaf, v in by_leaf.items())
        assert not {0, 61} <= set(kept)
        assert sorted(kept) == sorted(r.ordinal for r in select(s.repartition(7), g, policy).select("ordinal").collect())
    first = curate.select_first(s, g, policy)
    inv = curate.invariants(g, policy, first).first()
    assert (inv.groups_missing, inv.names_missing) == (0, 0)
    assert curate.invariants(g, policy, first.where("ordinal <> 60")).first().groups_missing == 1
    with pytest.raises(ValueError):
        curate.Policy(cap=0)


def test_percentiles_against_sorting(spark):
    for values in ([5], [1, 2], list(range(100)), [7] * 50 + [9]):
        got = curate.percentiles(spark.createDataFrame([(v,) for v in values], "length int")).first()
        v, n = sorted(values), len(values)
        for name, q in curate.QUANTILES.items():
            assert got[name] == v[min(int(n * q), n - 1)]


def test_fastx(spark, tmp_path):
    spark.dataSource.register(fastx.FastxSource)
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">one x\nAC\nGT\n>two\n\n")
    (tmp_path / "b.fq").write_text("@q\nACGT\n+\n!!~~\n")
    (tmp_path / "c.fa").write_text("")
    got = spark.read.format("fastx").load(str(tmp_path)).orderBy("file", "ordinal").collect()
    assert [(r.ordinal, r.label, r.seq, r.qual) for r in got] == [(0, "one x", "ACGT", None), (1, "two", "", None), (0, "q", "ACGT", "!!~~")]
    for text in ("@q\nACGT\n+\n!!~\n", ">\nAC\n", "ACGT\n", "@q\nAC\n+\n! \n"):
        with pytest.raises(ValueError):
            list(fastx.records(iter(text.splitlines(keepends=True))))
    with pytest.raises(ValueError):
        list(fastx.records(iter(["@q\n", "A\n", "+\n", "!\n"]), references=True))
    frame, rows = reads(spark, 5)
    fastx.write_fasta(frame.repartition(3), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [(a, b) for a, b, _ in fastx.records(iter(text.splitlines(keepends=True)))] == [(r[1], r[2]) for r in rows]


def test_rank_holdouts(spark):
    frame, _ = reads(spark, 16)
    recs = index.records(frame)
    vocab = recs.select(F.col("ordinal").alias("query"), "words")
    post = recs.select(F.explode("words").alias("word"), F.col("ordinal").alias("ref_id"))
    refs = recs.select(F.col("ordinal").alias("ref_id"), F.size("words").alias("vocabulary"))
    counted = rank.counts(vocab, post)
    plain = {r.ordinal: set(r.words) for r in recs.collect()}
    assert {(r.query, r.ref_id): r["count"] for r in counted.collect()} == {(a, b): n for a in plain for b in plain if (n := len(plain[a] & plain[b]))}
    left = {(r.query, r.ref_id) for r in rank.holdout_self(counted, vocab, refs).collect()}
    assert left == {(a, b) for a in plain for b in plain if plain[a] & plain[b] and plain[a] != plain[b]}
    hist = rank.histogram(counted, vocab, 16).groupBy("query").agg(F.sum("refs").alias("n")).collect()
    assert all(r.n == 16 for r in hist)


def test_sha_streams_and_packed_scores(spark):
    """The second stream hash, and scores of candidates against plain sums."""
    import hashlib

    own = hashlib.sha256(b"query:1:7:ACGT").hexdigest()
    seeds = scoring.stream_seeds("ACGT", 7, 1, 0, hash="sha256")
    assert int(seeds[42]) == int(hashlib.sha256(f"{own}:1:0:42".encode()).hexdigest()[:16], 16)
    frame, _ = reads(spark, 16)
    recs = index.records(frame)
    plain = {r.ordinal: set(r.words) for r in recs.collect()}
    post = recs.select(F.explode("words").alias("word"), F.col("ordinal").alias("ref_id"))
    q = recs.withColumnRenamed("ordinal", "query").where("query in (0, 5)")
    weights = post.select("word").distinct().withColumn("weight", F.when(F.col("word") % 3 == 0, 4).otherwise(1))
    few = spark.createDataFrame([(0, 0), (0, 8), (5, 13)], "query long, ref_id long")
    drawn = {}
    for r in scoring.draws(q, hash="sha256").collect():
        drawn.setdefault((r.query, r.boot), []).append((r.word, r.mult))
    got = {(r.query, r.boot, r.ref_id): r.score for r in scoring.unpacked(scoring.scores(scoring.draws(q, hash="sha256"), post, weights, few)).collect()}
    want = {(a, boot, b): n for a, b in ((0, 0), (0, 8), (5, 13)) for boot in range(100) if (n := sum(m * (4 if w % 3 == 0 else 1) for w, m in drawn[a, boot] if w in plain[b]))}
    assert got == want and max(got.values()) > 64


def test_stdin_and_several_files(spark, tmp_path, monkeypatch):
    import io
    import sys
    from types import SimpleNamespace

    from cladeforge.__main__ import _read

    (tmp_path / "x.fa").write_text(">a\nAC\n>b\nGT\n")
    (tmp_path / "y.fa").write_text(">c\nTT\n")
    got = sorted((r.ordinal, r.label, r.seq) for r in _read(spark, f"{tmp_path}/x.fa,{tmp_path}/y.fa").collect())
    assert got == [(0, "a", "AC"), (1, "b", "GT"), (2, "c", "TT")]
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(b">z\nACGT\n")))
    assert [(r.ordinal, r.label, r.seq) for r in _read(spark, "-").collect()] == [(0, "z", "ACGT")]
    uri = f"file://{tmp_path}/x.fa"
    assert spark.read.format("fastx").load(uri).count() == 2


def test_sketch_similarity_by_rows():
    rng = np.random.default_rng(4)
    own = [np.unique(rng.integers(0, 90, n)) for n in (0, 1, 5, 32, 32, 20)]
    own = [s[:32] for s in own]
    rows = curate.padded(own)
    for a in own:
        got = curate.alike(curate.padded([a])[0], rows)
        for g, b in zip(got, own, strict=True):
            union = sorted(set(a.tolist()) | set(b.tolist()))[:32]
            both = sum(x in a and x in b for x in union)
            assert g == np.float32(both) / np.float32(max(1, len(union)))


def test_maxmin_against_plain_python(spark):
    """Greedy farthest points, one at a time, by the stated order of choice."""
    frame, _ = reads(spark, 60)
    s = curate.survey(index.records(frame, sketches=True)).cache()
    g, policy = curate.groups(s).cache(), curate.Policy(cap=3, demote_length=299)
    rows, pool = {}, curate.eligible(s, g, policy)[0].cache()
    density = {r.ordinal: r.density for r in curate.lsh_density(pool).collect()}
    median = {r.leaf: r.median for r in curate.median_words(pool).collect()}
    for r in pool.collect():
        rows.setdefault(r.leaf, []).append(r)

    def near(a, b):
        u = sorted(set(a) | set(b))[:32]
        return np.float32(sum(x in a and x in b for x in u)) / np.float32(max(1, len(u)))

    want = set()
    for leaf, own in rows.items():
        if len(own) <= own[0].cap:
            want |= {r.ordinal for r in own}
            continue
        order = sorted(own, key=lambda r: (r.length > 299, r.ambiguous, abs(r.words - median[leaf]), r.ordinal))
        left, chosen = list(order), []
        while len(chosen) < own[0].cap and left:
            far = lambda r: min([np.float32(0.95), *(np.float32(1) - near(c.sketch, r.sketch) for c in chosen)]) if chosen else 0  # noqa: E731, B023
            now = max(left, key=lambda r: (r.length <= 299, far(r), density[r.ordinal], -order.index(r)))  # noqa: B023
            chosen.append(now)
            left.remove(now)
        want |= {r.ordinal for r in chosen}
    assert {r.ordinal for r in curate.select_maxmin(s, g, policy).collect()} == want
