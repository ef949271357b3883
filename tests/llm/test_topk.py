from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from loomwork.llm import topk
from loomwork.llm.store import Scratch
from pyspark.sql import functions as F


def table(spark, x: np.ndarray):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")


def brute_force(x: np.ndarray, k: int) -> list[tuple]:
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    s = np.round(np.einsum("ik,jk->ij", u, u), 6)
    out = []
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:k]
        out += [(i, r + 1, j, s[i, j]) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("shape", ["random", "clusters", "ties"])
def test_matches_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)).astype(np.float32)
    if shape == "clusters":
        x = (x[:10][rng.integers(0, 10, 300)] + 0.1 * x).astype(np.float32)
    if shape == "ties":
        x = x[rng.integers(0, 20, 300)]
    got = sorted((r.vec_id, r.rank, r.neighbour, r.score) for r in topk.top_k(table(spark, x), Scratch(spark, "t"), 10).collect())
    want = brute_force(x, 10)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.abs(np.array([g[3] for g in got]) - np.array([w[3] for w in want])).max() < 2e-6
    assert [g[2] for g in got] == [w[2] for w in want]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def test_thresholds_hold():
    """No object that the lists haven't shown scores more than the threshold."""
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((500, 8)))
    q, lists = x[:20], topk.SortedLists(x)
    signed, exact = np.hstack([np.maximum(q, 0), np.maximum(-q, 0)]), q @ x.T
    for depth in (0, 1, 8, 50, 499, 500):
        most = lists.threshold(signed, depth)
        for i in range(20):
            rest = np.setdiff1d(np.arange(500), lists.shown(q[i], depth))
            assert not len(rest) or exact[i, rest].max() <= most[i] + 1e-12


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.2), (None, 1.05)])
def test_multiplications_against_brute_force(spread, share):
    """In clusters blocks are left alone, and lists are read for a while; where nothing is near, a block costs hardly more than its scores."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((16, 32))
    x = unit(rng.standard_normal((16 * 256, 32)) if spread is None else np.repeat(centres, 256, axis=0) + spread * rng.standard_normal((16 * 256, 32)))
    q, k, made = x[::100], 10, 0
    best = topk.Best(np.arange(0, len(x), 100), k)
    for first in (True, False):
        for a in range(0, len(x), 256):
            lists = topk.SortedLists(x[a : a + 256])
            mine = (best.ids >= a) & (best.ids < a + 256) if first else (best.ids < a) | (best.ids >= a + 256)
            at = np.flatnonzero(mine)
            for r, o, s in lists.search(q[at], best.floor()[at]):
                best.add(at[r], o + a, s)
            made += lists.made
    exact = np.round(q @ x.T, 6)
    for i, row in enumerate(exact):
        want = sorted((j for j in range(len(x)) if j != best.ids[i]), key=lambda j: (-row[j], j))[:k]
        assert best.score[i].tolist() == pytest.approx([row[j] for j in want], abs=2e-6)
    assert made <= share * q.size * len(x), made / (q.size * len(x))


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 1.0]), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, [0.0, None]), (8, [-1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in ("score", "rank", "neighbour", "q", "x", "ids", "n")])
    got = {}
    for r in topk.top_k(df, Scratch(spark, "t"), 2).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 2), (2, 8)], 2: [(1, 1), (2, 8)], 8: [(1, 2), (2, 1)]}


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), Scratch(spark, "t")).count() == 0


def test_every_row_is_a_query_or_every_twentieth(spark):
    d = "/root/testdata/sf0.001/embeddings.parquet"
    ids = pq.read_table(d).column("vec_id").to_pylist()
    for every in (1, 20):
        out = topk.top_k(spark.read.parquet(d), Scratch(spark, "t"), every=every)
        assert sorted(r.vec_id for r in out.select("vec_id").distinct().collect()) == sorted(i for i in ids if i % every == 0)
        assert out.count() == 10 * sum(i % every == 0 for i in ids)
