import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeforge.llm import byte_bpe


@pytest.fixture(scope="module")
def pair():
    path = byte_bpe.vocabulary_path()
    ranks = byte_bpe.load_ranks(path)
    return byte_bpe.codec(path, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_hash_is_minimal_and_perfect(pair):
    bpe, _, ranks = pair
    assert bpe.hash.slots == len(ranks)
    assert all(bpe.hash.get(k) == r for k, r in ranks.items())
    assert all(bpe.hash.get(k + b"\xff\x00") == -1 for k in list(ranks)[:2000])


@given(st.one_of(st.text(max_size=60), st.text(alphabet=st.sampled_from("aAeth 's'll09\n\t  é中🙂.!"), max_size=120)))
@settings(max_examples=400, deadline=None)
def test_as_tiktoken(text):
    path = byte_bpe.vocabulary_path()
    bpe = byte_bpe.codec(path, public_tokenizers.PATTERN)
    enc = _tiktoken(path)
    assert bpe.encode(text) == enc.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


import functools  # noqa: E402


@functools.cache
def _tiktoken(path):
    return tiktoken.Encoding("own2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def test_report_and_long_pre_token(spark, pair):
    _, enc, _ = pair
    rows = [(1, "Hello, world's end", 7), (2, None, 7), (3, "", 7), (4, "ab" * 20_000, 7), (1, "Hello, world's end", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, byte_bpe.report(docs).collect())) == sorted(want)
    assert byte_bpe.report(docs.where(F.lit(False))).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs))
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t, _ in rows)
