import random
import zlib
from collections import defaultdict

import corpus_pipeline
from cladeforge.llm import chunk_tokens, markov_secrets, pu_quality, spans, toxicity_grammar

FILL = "river stone cloud window garden letter morning paper silver forest winter table music engine market bridge".split()


def write_tables(spark, path):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        words = rng.choices(FILL, k=rng.randint(20, 70))
        toxic, poor = i % 7 == 0, i % 5 == 1
        if toxic:
            words[rng.randrange(len(words))] = "dufflam"
        text = " | ".join(words) if poor else " ".join(words).capitalize() + "."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000 + k, rows[2][1], "en", "s", 1) for k in range(5)]
    rows += [(1200 + k, " ".join(["River", *rows[k][1].split()]), "en", "s", 1) for k in range(2, 600, 10)]
    labels += [(1200 + k, 1, 0) for k in range(2, 600, 10)]
    rows += [(1100, rows[3][1] + " password=abcdefgh1234", "en", "s", 1), (1101, None, "en", "s", 0), (1102, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)} - {""}


def components(sets):
    left, out = dict(sets), {}
    while left:
        seen, queue = set(), [min(left)]
        while queue:
            a = queue.pop()
            if a in left:
                p = left.pop(a)
                seen.add(a)
                queue += [b for b, q in left.items() if 5 * len(p & q) >= 4 * len(p | q)]
        out |= dict.fromkeys(seen, min(seen))
    return out


def test_stages_against_plain_python(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    want = {r.doc_id: r for r in docs.collect()}
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        out = stage(spark, before, str(tmp_path))
        if name == "toxicity":
            scorer = toxicity_grammar.train(before, labels)
            want = {i: r for i, r in want.items() if scorer.score(r.text or "") < 0.3}
            assert not any("dufflam" in (r.text or "") for r in want.values())
        elif name == "quality":
            net = pu_quality.train(before, labels)
            want = {i: r for i, r in want.items() if net.probability(pu_quality.features(r.text or "")[None])[0] >= 0.7}
            assert not any("|" in (r.text or "") for r in want.values()) and len(want) > 400
        elif name == "near_duplicates":
            group = components({i: shingles(r.text or "") for i, r in want.items()})
            assert sum(i >= 1200 and group[i] < 1000 for i in group) > 20
            want = {i: r for i, r in want.items() if group[i] == i}
            assert not want.keys() & set(range(1000, 1005)) and len(want) > 300
        elif name == "secrets":
            trained = markov_secrets.models(before)
            for i, r in want.items():
                base = spans.secrets(r.text or "")
                every = base + markov_secrets.random_runs(r.text or "", base, trained)
                if every:
                    want[i] = type(r)(**(r.asDict() | {"text": spans.replaced(r.text, [("[secret]", a, b) for _, a, b in every])}))
            assert not any("abcdefgh1234" in (r.text or "") for r in want.values())
        else:
            pieces = defaultdict(list)
            for r in out.collect():
                pieces[r.doc_id].append(r)
            tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
            assert pieces.keys() == want.keys()
            for i, own in pieces.items():
                ids = tok.whole(want[i].text or "") + (2).to_bytes(4, "little")
                assert all(zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in own)
                assert sum(p.length for p in own) == len(ids) // 4
            continue
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns
        assert {r.doc_id: r.text for r in now.collect()} == {i: r.text for i, r in want.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == sum(p.length for own in pieces.values() for p in own)


def test_null_and_reused_ids_and_empty_tables(spark, tmp_path):
    """No text is lost for its id: rows (null, null, 1, 1, 2), all but one of different texts."""
    text = lambda k: " ".join(random.Random(k).choices(FILL, k=60)).capitalize() + "."
    rows = [(None, text(1)), (None, text(2)), (1, text(3)), (1, text(4)), (2, text(5)), (None, text(5)), (2, text(5))]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(i, t) for i, t in rows[:5]], key=str)
    got = corpus_pipeline.run(spark, str(tmp_path))
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    assert got.agg({"length": "sum"}).first()[0] == sum(len(tok.whole(t)) // 4 + 1 for _, t in rows[:5])
    (tmp_path / "empty").mkdir()
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
