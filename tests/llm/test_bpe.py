from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from loomwork.llm import bpe
from loomwork.llm import kernels as K
from tokenizers import Tokenizer

from .common import awkward, docs, nothing


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def encoded(v, texts: list[str]) -> list[list[int]]:
    data, off = K.flat(pa.array(texts, pa.string()))
    tok, at = bpe.encode_chunk(data, off, v)
    return [tok[a:b].tolist() for a, b in zip(at, at[1:])]


def test_same_tokens_as_the_public_implementation(vocabulary, public):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    got = encoded(vocabulary, texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_awkward_texts(vocabulary, public):
    rng = random.Random(5)
    pool = ["'s", "'ll", "'re", "'", "''", " '", "'S", " ", "  ", "\n", "\t", " ", "　", "a", "Zz", "é", "ß", "漢字", "🙂", "👩‍👩‍👧", "1", "²", "٣", "!", "...", "<|endoftext|>", "\x1c", "\x00", "ﬁ", "á"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(1500)] + ["aaaaaaaaaaaaaaaaa" * 9, "", " ", "'"]
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    got = encoded(vocabulary, texts)
    bad = [(texts[i], got[i], want[i]) for i in range(len(texts)) if got[i] != want[i]]
    assert not bad, bad[:3]


def test_replay_matches_merging_word_by_word(vocabulary):
    """Against the usual greedy loop: the adjacent pair of least rank, again and again."""
    rng = random.Random(6)
    v = vocabulary
    rank = {(a, b): (i, n) for i, (a, b, n) in enumerate(zip(v.left.tolist(), v.right.tolist(), v.new.tolist(), strict=True))}
    words = [bytes(rng.choice(b"aabbcdeeeinst ") for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    want = []
    for w in words:
        s = v.byte_id[list(w)].tolist()
        while True:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
            if best is None:
                break
            i = best[1]
            s[i : i + 2] = [rank[s[i], s[i + 1]][1]]
        want.append(s)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    tok, at = bpe.replay(v.byte_id[np.frombuffer(b"".join(words), np.uint8)], first, v)
    assert [tok[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_round_trip_in_spark(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = bpe.encode(df)
    assert out.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(out).collect()}
    assert back == {r.doc_id: r.text for r in df.collect()}


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = bpe.encode(df).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].tokens is None and by[3][0].n_tokens is None and by[3][0].round_trip is None
    assert by[4][0].tokens == [] and by[4][0].n_tokens == 0
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in rows if r.tokens is not None)
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in back])) == sorted(map(repr, [(r.doc_id, r.text) for r in df.collect()]))


def test_chunks_do_not_matter(vocabulary, spark, monkeypatch):
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()][:60]
    whole = encoded(vocabulary, texts)
    monkeypatch.setattr(K, "SLICE_BYTES", 500)
    assert encoded(vocabulary, texts) == whole
    assert [encoded(vocabulary, [t])[0] for t in texts] == whole


def test_empty_table(spark):
    assert bpe.encode(nothing(spark)).count() == 0
    assert bpe.decode(bpe.encode(docs(spark, []))).count() == 0


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62C3') AS string) AS text UNION ALL SELECT 2, 'fine \u00e9'")
    got = {r.doc_id: r for r in bpe.encode(df).select("doc_id", "round_trip", "tokens").collect()}
    assert got[1].round_trip and got[2].round_trip
    v = bpe.Vocabulary()
    assert v.decode(np.array(got[1].tokens)).tobytes() == b"a\xffb\xc3"


def test_words_that_a_worker_knows_change_nothing(monkeypatch):
    v = bpe.Vocabulary()
    texts = ["the quick brown fox", "the lazy dog", "", "fox and dog and the rest", "x" * 300]
    fresh = []
    for t in texts:
        v.known = None
        fresh.append(bpe.encode_chunk(*K.flat(pa.array([t])), v)[0].tolist())
    v.known = None
    assert [bpe.encode_chunk(*K.flat(pa.array([t])), v)[0].tolist() for t in texts * 2] == fresh * 2
    monkeypatch.setattr(bpe, "MAX_KNOWN", 3)
    assert [bpe.encode_chunk(*K.flat(pa.array([t])), v)[0].tolist() for t in texts * 2] == fresh * 2
