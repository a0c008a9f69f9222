import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeforge.llm import chunk_tokens, packed_ids


@given(st.text(alphabet=st.sampled_from("aB'sé́ÀßÑ \t\n\x1c\x85\xa0 ..,!$09İΣß中<|>endoftx"), max_size=80))
@settings(max_examples=400, deadline=None)
def test_chunks_give_the_ids_of_the_whole(text):
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    assert tok.encode(text) == tok.whole(text)
    assert tok.encode(text + " <|endoftext|> x") == tok.whole(text + " <|endoftext|> x")


@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\x1cÉ.!"), max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_many_texts(many):
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    ids, offsets = tok.encode_all(pa.array(["skipped", *many], pa.string()).slice(1))
    assert [ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])] == [tok.whole(t) + (2).to_bytes(4, "little") for t in many]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(chunk_tokens, "MEMO_BYTES", 400)
    tok = chunk_tokens.ChunkTokenizer(chunk_tokens.vocabulary_path())
    kept = 0
    for i in range(20):
        text = " ".join(f"w{j}" for j in range(i, i + 4)) + " plain words, of letters."
        assert tok.encode(text) == tok.whole(text)
        assert tok.words.nbytes + tok.flat.nbytes + tok.offsets.nbytes <= 400
        kept += len(tok.words) > 0
    assert kept


@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\x1cÉ.!"), max_size=12), max_size=6))
@settings(max_examples=100, deadline=None)
def test_sums_by_text(many):
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    value = np.arange(tok.vocabulary_size) * 7 % 11 - 5
    found = tok.chunks(pa.array(many, pa.string()))
    ids, at = found.ids(), found.offsets
    assert found.sums(value).tolist() == [value[ids[a:z]].sum() for a, z in zip(at, at[1:])]


def test_blocks_of_chunks_give_the_same(monkeypatch):
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    value = np.arange(tok.vocabulary_size) * 7 % 11 - 5
    for block in (1, 3, 1 << 16):
        monkeypatch.setattr(chunk_tokens, "BLOCK", block)
        many = ["", "a b c d e f", "a", "", "x\x1cy z", "b c.", "a <|endoftext|> b", ""]
        found = tok.chunks(pa.array(many, pa.string()))
        ids, at = found.ids("<u2"), found.offsets
        assert [ids[a:z].astype("<u4").tobytes() for a, z in zip(at, at[1:])] == [tok.whole(t) + (2).to_bytes(4, "little") for t in many]
        assert found.sums(value).tolist() == [value[ids[a:z]].sum() for a, z in zip(at, at[1:])]
    assert not len(tok.chunks(pa.array([], pa.string())).ids())


def test_ids_and_sums_need_little_beside_their_results():
    """Ids of 600,000 chunks: 1.2 MB as u2. All at once took some 70 bytes a chunk (pipeline: packing out of memory)."""
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    value = np.arange(tok.vocabulary_size) * 7 % 11 - 5
    found = tok.chunks(pa.array(["the word of a text " * 60] * 2_000, pa.string()))
    tracemalloc.start()
    try:
        ids = found.ids("<u2")
        found.sums(value)
        assert len(ids) > 600_000 and tracemalloc.get_traced_memory()[1] < 12e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_round_trip_and_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, np.uint32) for n in (0, 1, 5, 300, 0, 77)]
    w = packed_ids.Writer(bits, block=32)
    for a, z in ((0, 2), (2, 3), (3, 6)):
        w.add([i - (1 << 63) if i else None for i in range(a, z)], np.cumsum([0, *map(len, docs[a:z])]), np.concatenate(docs[a:z]))
    w.save(f"file://{tmp_path}/a.ids")
    r = packed_ids.Reader(packed_ids.read_file(f"file://{tmp_path}/a.ids"))
    assert all((r.document(k) == d).all() for k, d in enumerate(docs))
    assert r.doc_ids == [None, *(i - (1 << 63) for i in range(1, 6))]
    flat = np.concatenate(docs)
    for a, n in ((0, 0), (3, 40), (31, 2), (64, 100), (382, 1)):
        assert (r.read(a, n) == flat[a : a + n]).all()


def test_report(spark):
    rows = [(5, "One two", 1), (3, None, 1), (9, "x" * 100_000, 1), (3, "again, again", 1), (7, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    tok = chunk_tokens.tokenizer(chunk_tokens.vocabulary_path())
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = tok.whole(t or "") + (2).to_bytes(4, "little")
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, packed_ids.token_id_report(docs).collect())) == sorted(want)
    assert packed_ids.token_id_report(docs.where(F.lit(False))).count() == 0


def test_files_of_bounded_size(spark, monkeypatch):
    """A range goes on in another file; starts run on over files."""
    rows = [(i, "many words here " * (i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = packed_ids.token_id_report(docs).orderBy("doc_id").collect()
    write = packed_ids.write
    monkeypatch.setattr(packed_ids, "FILE_IDS", 50)
    monkeypatch.setattr(packed_ids, "text_slices", lambda batches, chars: (b.slice(a, 10) for b in batches for a in range(0, b.num_rows, 10)))
    manifest = write(docs, packed_ids.fresh_path(spark, "small-files"))
    assert manifest.count() > 8
    got = packed_ids.read_back(packed_ids.located(manifest))
    assert got.orderBy("doc_id").collect() == want
