import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeforge.llm import order_minhash as om


def slow(text, k=om.K, functions=om.FUNCTIONS, smallest=om.SMALLEST):
    """One text, element by element, in Python integers."""
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m
        x ^= x >> 29
        x = x * 0xC4CEB9FE1A85EC53 & m
        return x ^ x >> 32

    text = text + "\0" * max(0, k - len(text))
    seen, elements = {}, []
    for i in range(len(text) - k + 1):
        g = int(om._kmers(np.array([ord(c) for c in text[i : i + k]], np.uint32), k)[0]) & ~((1 << 20) - 1)
        n = seen[g] = seen.get(g, -1) + 1
        elements.append((mix(g + n * 0x9E3779B97F4A7C15 & m) >> 32, i, g))
    out = []
    for f in range(1, functions + 1):
        c = mix(f * 0x9E3779B97F4A7C15 & m) >> 32 | 1
        ranked = sorted((e * c & 0xFFFFFFFF, g, i) for e, i, g in elements)[:smallest]
        total = 0
        for _, g, _ in sorted(ranked, key=lambda r: r[2]):
            total = mix((total * 0xC4CEB9FE1A85EC53 + g + 0x9E3779B97F4A7C15) & m)
        out.append(total >> 32)
    return out


@given(st.lists(st.text(alphabet="ab é中", max_size=70), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
@pytest.mark.filterwarnings("ignore:overflow")
def test_as_element_by_element(many):
    assert om.signatures(many).tolist() == [slow(t) for t in many]


@pytest.mark.filterwarnings("ignore:overflow")
def test_long_texts_and_batches_agree():
    rng = random.Random(1)
    many = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (3000, 5, 900)]
    assert om.signatures(many).tolist() == [slow(t) for t in many]
    big = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) + 500))
    assert (om.signatures([big, many[0]])[1] == om.signatures([many[0]])[0]).all()


def test_order_matters_and_edits_lower_likeness():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400)]
    base = " ".join(words)
    swapped = " ".join(words[200:] + words[:200])
    some = " ".join(w if i % 40 else "zzzzzzz" for i, w in enumerate(words))
    sig = om.signatures([base, swapped, some, base])
    like = om.likeness(np.repeat(sig[:1], 4, 0), sig)
    assert like[3] == 1 and like[1] < 0.75 and 0.3 < like[2] < 1


def test_neighbours(spark):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choice("abc d") for _ in range(rng.choice([0, 1, 9, 300]))), "x") for i in range(60)]
    rows += [(4, None, "x"), (6, "twice", "x"), (6, "twice", "x"), (1000, "long " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    ordered = sorted((i, t or "") for i, t, _ in rows)
    want = []
    for j, (i, t) in enumerate(ordered):
        n = ordered[(j + 1) % len(ordered)][1]
        changed = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = om.signatures([t, changed, n])
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), om.as_text(a), om.as_text(b), float((a == b).mean()), float((a == c).mean())))
    assert sorted(map(tuple, om.neighbours(docs).collect())) == sorted(want)
    assert om.neighbours(docs.where(F.lit(False))).count() == 0
    one = om.neighbours(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1
