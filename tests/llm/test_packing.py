from __future__ import annotations

import random
import re
from functools import lru_cache

import corpus_pipeline
import numpy as np
import pytest
from loomwork.llm import bpe, packing, queries
from loomwork.llm.store import Scratch
from pyspark.sql import functions as F

from .common import awkward, docs, nothing, text


def cost_of(cuts: list[int], length: list[int], doc_end: list[bool], capacity: int, truncation: float, inside: float) -> float:
    out, lo = 0.0, 0
    for hi in cuts:
        n = sum(length[lo:hi])
        assert n <= capacity or hi == lo + 1
        out += max(0, capacity - n) + truncation * max(0, n - capacity) + (0 if doc_end[hi - 1] else inside)
        lo = hi
    assert lo == len(length)
    return out


def brute_force(length, doc_end, capacity, truncation, inside) -> float:
    @lru_cache(None)
    def best(j: int) -> float:
        if j == 0:
            return 0.0
        out = float("inf")
        for i in range(j):
            n = sum(length[i:j])
            if n <= capacity or i == j - 1:
                out = min(out, best(i) + max(0, capacity - n) + truncation * max(0, n - capacity) + (0 if doc_end[j - 1] else inside))
        return out

    return best(len(length))


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    length = [rng.randrange(1, 30) for _ in range(n)]
    doc_end = [rng.random() < 0.3 for _ in range(n - 1)] + [True]
    args = (rng.choice([12, 25, 40]), rng.choice([0.5, 2.0, 9.0]), rng.choice([0.0, 3.0, 16.0]))
    cuts = packing.best_cuts(np.array(length), np.array(doc_end), *args)
    assert cost_of(cuts, length, doc_end, *args) == pytest.approx(brute_force(length, doc_end, *args))


def test_windows_hold_every_token_in_order(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randrange(1, 700))) for i in range(40)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    out = packing.pack(docs(spark, shuffled), Scratch(spark, "t"), capacity=128, shard=16).orderBy("shard", "window").collect()
    assert " ".join(r.text for r in out).split() == " ".join(t for _, t in rows).split()
    assert all(r.n_tokens == len(r.text.split()) and r.padding == max(0, 128 - r.n_tokens) and r.truncated == max(0, r.n_tokens - 128) for r in out)
    assert all(set(r.doc_ids) == set(range(min(r.doc_ids), max(r.doc_ids) + 1)) for r in out)
    # windows end at sentence ends
    ends = {t[k] for _, t in rows for k in [-1]} | set(".!?")
    assert all(r.text[-1] in ends or r.truncated for r in out)
    pieces = {x for _, t in rows for x in re.split(r"(?<=[.!?])\s+|\n+", t)}
    assert all(any(r.text.endswith(x) for x in pieces if x) for r in out)
    assert sum(r.padding for r in out) < 0.1 * sum(r.n_tokens for r in out)


def test_partitions_do_not_matter(spark):
    rng = random.Random(6)
    df = docs(spark, [(i, text(rng, 90)) for i in range(60)])
    a = packing.pack(df, Scratch(spark, "t"), capacity=100, shard=20).orderBy("shard", "window").collect()
    assert a == packing.pack(df.repartition(7), Scratch(spark, "t"), capacity=100, shard=20).orderBy("shard", "window").collect()


def windows(df) -> list:
    return df.orderBy("shard", "window").collect()


def test_sparse_ids_are_packed_like_dense_ones(spark):
    rng = random.Random(8)
    texts = [text(rng, 60) for _ in range(100)]
    dense = windows(packing.pack(docs(spark, list(enumerate(texts))), Scratch(spark, "t"), capacity=100, shard=20))
    sparse = windows(packing.pack(docs(spark, [((i - 50) * 10**15 + 7, t) for i, t in enumerate(texts)]), Scratch(spark, "t"), capacity=100, shard=20))
    assert [(r.shard, r.window, r.text) for r in sparse] == [(r.shard, r.window, r.text) for r in dense]
    assert sum(r.padding for r in sparse) < 0.1 * sum(r.n_tokens for r in sparse)


def test_ranks_by_broadcast_and_by_join(spark, monkeypatch):
    """Shards are runs of ranks, whatever repeats: null ids, one id of many texts, and rows that are the same altogether."""
    rng = random.Random(9)
    one = text(rng, 30)
    plain = [(None, text(rng, 30)) for _ in range(25)] + [(7, text(rng, 30)) for _ in range(25)] + [(i, text(rng, 30)) for i in range(50, 90)]
    for rows in (plain, plain + [(7, one)] * 33 + [(None, one)] * 3):
        df = docs(spark, rows)
        order = sorted(((-(1 << 70) if r.doc_id is None else r.doc_id, r.h, r.text) for r in df.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()))
        want = sorted((n // 10, i, h) for n, (i, h, _) in enumerate(order))
        for most in (packing.MAX_BROADCAST_SHARDS, 0):
            monkeypatch.setattr(packing, "MAX_BROADCAST_SHARDS", most)
            got = packing.ranked(df.select("doc_id", F.xxhash64("text").alias("h"), "text"), 10, Scratch(spark, "t")).collect()
            assert sorted((r.shard, -(1 << 70) if r.doc_id is None else r.doc_id, r.h) for r in got for _ in range(r.times)) == want
            monkeypatch.undo()
        out = windows(packing.pack(df, Scratch(spark, "t"), capacity=50, shard=10))
        assert sum(r.n_tokens for r in out) == sum(len(t.split()) for _, t in rows)
        assert max(r.shard for r in out) == (len(rows) - 1) // 10


def test_counter_of_tokens(spark):
    out = packing.pack(docs(spark, [(0, "abc de. fgh. ij")]), Scratch(spark, "t"), capacity=8, inside=0.0, count=lambda s: [len(x) for x in s]).collect()
    assert [(r.n_tokens, r.text) for r in out] == [(7, "abc de."), (6, "fgh. ij")] or sum(r.n_tokens for r in out) == 13


def test_tokens_are_those_of_the_vocabulary(spark, tmp_path):
    blob = "aGVsbG8gd29ybGQhIQ" * 1000  # one word of 18,000 letters
    rows = [(0, blob), *((i, text(random.Random(i), 200)) for i in range(1, 9))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    v = bpe.Vocabulary()
    tables = [queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs(spark, rows), str(tmp_path))]
    for out in [t.orderBy("shard", "window").collect() for t in tables]:
        assert " ".join(r.text for r in out).split() == " ".join(t for _, t in rows).split()
        raw = [r.text.encode() for r in out]
        real = bpe.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), v).tolist()
        assert all(abs(r.n_tokens - n) <= 3 and r.truncated == max(0, r.n_tokens - packing.CAPACITY) for r, n in zip(out, real, strict=True))
        (long,) = [r for r in out if blob in r.text]
        assert long.text == blob and long.truncated > 1000


def test_sentence_longer_than_a_window_is_whole(spark):
    long = " ".join(["word"] * 50)
    (r,) = packing.pack(docs(spark, [(0, long)]), Scratch(spark, "t"), capacity=20).collect()
    assert (r.n_tokens, r.padding, r.truncated, r.text) == (50, 0, 30, long)


def test_awkward_rows(spark):
    df = awkward(spark)
    out = packing.pack(df, Scratch(spark, "t")).collect()
    want = sorted(w for r in df.collect() if r.text for w in r.text.split())
    assert sorted(w for r in out for w in r.text.split()) == want
    assert {r.shard for r in out} == {0}


def test_empty_table(spark):
    assert packing.pack(nothing(spark), Scratch(spark, "t")).count() == 0
