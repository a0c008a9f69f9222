import hashlib
import math
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeforge.llm import disclosure, spans


def corpus():
    rows = []
    fill = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()

    def words(n, k):
        return " ".join(fill[(k * 7 + j * j + j) % 10] + chr(97 + (k + j) % 26) for j in range(n))

    for k in range(6):  # a name met with one address, in different surroundings
        rows.append((k, f"{words(20, k)} Mirabel wrote mirabel.q@example.org {words(20, k + 50)}"))
    rows.append((6, f"{words(9, 3)} and later Mirabel left {words(9, 5)}"))
    for k in range(10, 18):  # copies: one surrounding, no evidence
        rows.append((k, f"{words(20, 77)} Corvin called +1 (202) 555-0100 {words(20, 78)}"))
    for k in range(20, 60):
        rows.append((k, words(60, k * 3)))
    for k in range(30, 32):  # an address in two documents, a name a sentence away
        rows.append((k + 100, f"{words(15, k)} Tamsin of the harbour office {words(14, k + 9)} reach t.a@example.net {words(30, k + 5)}"))
    for k in range(12):  # near copies that change a word by the entity: few surroundings for as many documents
        rows.append((k + 200, f"{words(20, 5)} Holbrook {'so' if k % 6 else 'ever'} writes 10.1.2.3 {words(20, 6)}"))
    rows += [(60, None), (61, ""), (61, ""), (62, "quiet " * 50_000 + "1.2.3.4"), (None, "Mirabel")]
    return rows


def slow_terms(rows):
    docs = [t or "" for _, t in rows]
    n_et, around, n_e = Counter(), defaultdict(set), Counter()
    for t in docs:
        for e, term, a in disclosure.neighbours(t):
            if e:
                n_et[e, term] += 1
                around[e, term].add(a)
            else:
                n_e[term] += 1
    n_t = Counter(w for t in docs for w in {m.casefold() for m in disclosure._WORD.findall(t)})
    out = {}
    for (e, term), n in n_et.items():
        ic = math.log(len(docs) / n_e[e])
        share = math.log(len(docs) * n / (n_e[e] * n_t[term])) / ic
        different = len(around[e, term])
        if different >= max(2, min(disclosure.EVIDENCE, n_e[e])) and 2 * different >= n and share >= disclosure.GENERALISE:
            out[term] = max(out.get(term, 0), share)
    return out


def test_terms_and_report(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, terms string")
    want = slow_terms(rows)
    assert {"mirabel", "tamsin"} <= set(want) and not {"corvin", "holbrook"} & set(want)
    terms, _ = disclosure.disclosing_terms(docs)
    kinds = {r.term: r.kind for r in terms.collect()}
    got = {r.term: r.share for r in terms.collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    key = lambda r: (r[0] is None, r)
    seen = sorted(map(tuple, disclosure.report(docs).collect()), key=key)
    expected = []
    for i, t in rows:
        base = spans.pii(t or "")
        more = [("term", *m.span()) for m in disclosure._WORD.finditer(t or "") if m[0].casefold() in want and not any(a < m.end() and m.start() < z for _, a, z in base)]
        n = Counter(k for k, _, _ in base)
        gone = [s for s in more if want[t[s[1] : s[2]].casefold()] >= disclosure.REMOVE]
        text = spans.replaced(t or "", [(f"[{k}]", a, z) for k, a, z in base] + [("" if s in gone else f"[near {kinds[t[s[1] : s[2]].casefold()]}]", *s[1:]) for s in more])
        expected.append((i, *(n[k] for k in spans.PII_KINDS), hashlib.sha256(spans.joined(base).encode()).hexdigest(), spans.joined(spans.ordered(base + more, (*spans.PII_KINDS, "term"))), len(more) - len(gone), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    assert seen == sorted(expected, key=key)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert "irabel" not in clean[0] and "[email]" in clean[0] and "Corvin" in clean[10] and clean[20] == rows[15][1]


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "plain words", 0), (2, None, 0)], "doc_id long, text string, base int")
    assert [r.spans for r in disclosure.report(docs).collect()] == ["", ""]
    assert disclosure.report(docs.where(F.lit(False))).count() == 0


def test_a_text_of_addresses_takes_linear_time():
    took = []
    for n in (2_500, 20_000):
        text = " ".join(f"write to a{i}@example.org about it" for i in range(n))
        began = time.process_time()
        assert sum(e == "" for e, _, _ in disclosure.neighbours(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_filter_grows_with_the_terms(spark):
    terms = spark.range(20_000).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"))
    bits = disclosure.term_filter(terms)
    assert 8 * len(bits) >= 16 * 20_000
    passes = disclosure.Filter(bits)
    assert all(passes(f"term{i}") for i in range(20_000)) and sum(bool(passes(f"other{i}")) for i in range(5_000)) < 100


def test_the_report_scans_for_terms_once(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(corpus(), "doc_id long, text string").write.parquet(path)
    report = disclosure.report(spark.read.parquet(path))  # what it found was written: no second scan of the documents
    assert report.where("spans like '%term:%'").count() and not [f for f in report.inputFiles() if "documents.parquet" in f]


def test_filter_of_texts(spark, monkeypatch):
    members = ["alpha", "beta", "straße".casefold(), "ὀδυσσεύς".casefold(), "東京都庁"]
    bits = disclosure.term_filter(spark.createDataFrame([(m,) for m in members], "term string"))
    odd = ["", "  \x1f　", "Alpha,beta;ALPHA x", "STRASSE straße-alpha", "a_alpha9beta²", "東京都庁。alpha東京都庁", "al pha", "beta" * 40 + " " + "alpha," * 40, "ὈΔΥΣΣΕΎΣ!", "ab be12ta beta\x85beta"]
    texts = [*odd, *(f"{'abcdefghij'[k % 10]}rare{chr(97 + k // 10)} alpha. {odd[k % 10]}" for k in range(200)), *odd]
    hashed = Counter()
    slots = disclosure._slots
    monkeypatch.setattr(disclosure, "_slots", lambda t, n: hashed.update([t]) or slots(t, n))
    for most in (4, 64, 1000):
        monkeypatch.setattr(disclosure, "MEMO_TOKENS", most)
        passes, plain = disclosure.Filter(bits), disclosure.Filter(bits)
        for text in texts:
            assert passes.terms(text) == {t for w in disclosure._WORD.findall(text) if (t := plain(w))}
        assert set(members) & passes.terms(texts[5]) == {"東京都庁"} and len(passes.young) <= most and len(passes.old) <= most
    hashed.clear()
    monkeypatch.setattr(disclosure, "MEMO_TOKENS", 50)
    passes = disclosure.Filter(bits)
    for k in range(100):  # rare tokens pass by, the one that comes again stays
        passes.terms("again " + " ".join("".join(chr(97 + (k * 20 + j) // 26**i % 26) for i in range(4)) for j in range(20)))
    assert hashed["again"] == 1 and len(hashed) == 2001
