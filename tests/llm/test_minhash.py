from __future__ import annotations

import random

import numpy as np
import pytest
from loomwork.llm import kernels as K
from loomwork.llm import minhash
from loomwork.llm.store import Scratch, components
from pyspark.sql import functions as F

from .common import awkward, docs, letter_words, nothing, text


def jaccard(a: str, b: str, k: int = minhash.SHINGLE) -> float:
    sets = []
    for t in (a, b):
        w = letter_words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    x, y = sets
    return len(x & y) / max(1, len(x | y))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, originals = [], [text(rng, rng.randrange(40, 400)) for _ in range(120)]
    for i, t in enumerate(originals):
        rows.append((i, t))
    n = len(rows)
    for i in range(0, 60):  # near copies: a few words changed
        w = originals[i].split(" ")
        for _ in range(max(1, len(w) // 50)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
        rows.append((n + i, " ".join(w)))
    rows += [(500 + i, originals[7]) for i in range(40)]  # a group of many copies
    rng.shuffle(rows)
    return rows


def test_groups_match_brute_force(spark, corpus):
    got = {r.doc_id: r.rep_id for r in minhash.near_duplicates(docs(spark, corpus), Scratch(spark, "t")).collect()}
    by = dict(corpus)
    pairs = [(a, b) for a in by for b in by if a < b and jaccard(by[a], by[b]) >= 0.75]
    group = lambda i: got.get(i, i)
    found = sum(group(a) == group(b) for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    assert all(jaccard(by[a], by[b]) > 0.3 for a, b in got.items())
    assert all(r < i and r not in got for i, r in got.items())
    kept = minhash.drop_near_duplicates(docs(spark, corpus), Scratch(spark, "t")).select("doc_id").collect()
    assert {r.doc_id for r in kept} == set(by) - set(got)


def test_similarity_estimates_jaccard(spark, corpus):
    by = dict(corpus)
    rows = minhash.near_duplicates(docs(spark, corpus), Scratch(spark, "t")).collect()
    errors = [abs(r.similarity - jaccard(by[r.doc_id], by[r.rep_id])) for r in rows]
    assert np.mean(errors) < 0.06


def test_densification_fills_bins_alike_for_equal_sets():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 9, dtype=np.uint64)
    sig = K.one_permutation(np.concatenate([h, h[::-1]]), np.repeat([0, 1], 9), 3, 64)
    assert (sig[0] == sig[1]).all() and (sig[0] != K.EMPTY).all()
    assert (sig[2] == K.EMPTY).all()
    assert set(sig[0]) <= set(h.astype(np.uint32))


def test_estimate_is_unbiased_for_sparse_sets():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2)
        a, b = h[:20], h[10:]  # 10 of 30 shared
        sig = K.one_permutation(np.concatenate([a, b]), np.repeat([0, 1], 20), 2, 128)
        got.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(got) - 1 / 3) < 0.02


def linked_in(spark, rows, kinds):
    """Pairs that are found among rows (bucket, id), where those of one kind are alike."""
    df = spark.createDataFrame(rows, "bucket bigint, id bigint")
    what = spark.createDataFrame([(i, str(k).encode()) for i, k in sorted(kinds.items())], "id bigint, what binary")
    keys = df.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))

    def compare(kind):
        return lambda a, b: np.array([kind[i] == kind[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)

    return {frozenset(p) for p in map(tuple, minhash.linked(minhash.meeting(df), keys, what, compare, Scratch(spark, "t")).collect())}


def test_bucket_with_an_unlike_centre(spark):
    kinds = {i: i % 2 for i in range(30)}
    pairs = linked_in(spark, [(1, i) for i in kinds] + [(2, 5), (3, 5), (3, 8)], kinds)
    assert len(pairs) == 28 and all(kinds[min(p)] == kinds[max(p)] for p in pairs)


def test_a_further_band_parts_a_polluted_bucket(spark):
    """Two that are alike meet by a further band among many that share one bucket alone."""
    kinds = {i: i for i in range(3000)} | {5000: -1, 5001: -1}
    rows = [(1, i) for i in kinds] + [(100 + i, i) for i in range(3000)] + [(9, 5000), (9, 5001)]
    assert linked_in(spark, rows, kinds) == {frozenset((5000, 5001))}


def test_buckets_that_go_on_over_blocks(spark):
    """Centres are held from block to block: every member of the first kinds is linked to one of them."""
    n = 3 * minhash.BLOCK
    kinds = {i: i % 3 for i in range(n)}
    pairs = linked_in(spark, [(1, i) for i in range(n)] + [(0, 1), (0, 4)], kinds)
    assert len({max(p) for p in pairs} | {min(p) for p in pairs}) == n and n - 3 <= len(pairs) <= n - 2


def test_comparisons_of_a_bucket_are_bounded():
    """20,000 unlike members: no square."""
    n, made = 20_000, []

    def alike(a, b):
        made.append(len(a))
        return np.zeros(len(a), bool)

    rows, _, none, centres = minhash.link_block(np.zeros(n, np.int64), 0, alike)
    assert not len(rows) and len(centres) == minhash.CENTRES and len(none) == n - minhash.CENTRES
    assert sum(made) <= minhash.CENTRES * n


def test_every_centre_meets_every_member():
    kind = np.array([0, 1, 0, 1, 2, 2, 0])
    bucket = np.array([0, 0, 0, 0, 0, 0, 1])
    rows, centres, none, _ = minhash.link_block(bucket, 0, lambda a, b: np.abs(kind[a] - kind[b]) <= 1)
    assert set(zip(rows.tolist(), centres.tolist(), strict=True)) == {(1, 0), (2, 0), (3, 0), (1, 4), (3, 4), (5, 4)} and not len(none)


def least_of_all_pairs(buckets, alike):
    """By brute force: of each member that shares buckets with alike ones, the least that it is linked to."""
    parent = {i: i for b in buckets.values() for i in b}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for b in buckets.values():
        for x in b:
            for y in b:
                if x < y and alike(x, y):
                    p, q = sorted((root(x), root(y)))
                    parent[q] = p
    return {i: root(i) for i in parent if root(i) != i}


def test_no_pair_of_a_bucket_is_lost(spark, monkeypatch):
    """More kinds than centres, of which every member shares one bucket alone; chains that touch no centre; buckets of several squares."""
    monkeypatch.setattr(minhash, "PART", 16)
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rng = random.Random(6)
    places = {i: (rng.randrange(600), rng.randrange(600)) for i in range(900)}
    buckets = {1: list(range(500)), 2: list(range(480, 700)), 3: [*range(700, 760)], **{10 + k: rng.sample(range(700, 900), 9) for k in range(30)}}
    alike = lambda x, y: abs(places[x][0] - places[y][0]) + abs(places[x][1] - places[y][1]) <= 25
    rows = [(b, i) for b, those in buckets.items() for i in those]
    df = spark.createDataFrame(rows, "bucket bigint, id bigint")
    what = spark.createDataFrame([(i, np.array(p, np.int64).tobytes()) for i, p in places.items()], "id bigint, what binary")
    keys = df.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))

    def compare(raw):
        x = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        return lambda a, b: np.abs(x[a] - x[b]).sum(axis=1) <= 25

    got = [tuple(r) for r in minhash.linked(minhash.meeting(df), keys, what, compare, Scratch(spark, "t")).collect()]
    want = least_of_all_pairs(buckets, alike)
    assert len(got) == len(want) and dict(got) == want


def test_buckets_of_the_same_members_are_linked_once(spark):
    """Of like lines most bands meet: one of their buckets is compared, and any bucket that has a member more or less."""
    buckets = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 3], 4: [1, 2, 3, 4], 5: [1, 3], 6: [2, 5, 9], 7: [2, 6, 9], 8: [2, 5, 6, 9]}
    df = spark.createDataFrame([(b, i) for b, those in buckets.items() for i in those], "bucket bigint, id bigint")
    got = {}
    for r in minhash.unlike_buckets(df).collect():
        got.setdefault(r.bucket, []).append(r.id)
    assert {b: sorted(i) for b, i in got.items()} == {b: those for b, those in buckets.items() if b not in (2, 5)}


def test_all_pairs_of_groups(monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 5)
    group = np.repeat(np.arange(6), [1, 4, 2, 1, 9, 1])
    got = [p for a, b in minhash.pairs_within(group) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(got) == [(a, b) for a in range(18) for b in range(a + 1, 18) if group[a] == group[b]]


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = {r.doc_id: r.rep_id for r in minhash.near_duplicates(df, Scratch(spark, "t")).collect()}
    assert rows == {1: -4, 2: -4}
    kept = minhash.drop_near_duplicates(df, Scratch(spark, "t"))
    assert kept.columns == df.columns
    assert kept.count() == df.count() - 3  # both rows of 1, and 2


def test_scratch_keeps_the_result_only(spark, corpus):
    from pathlib import Path

    s = Scratch(spark, "t")
    minhash.near_duplicates(docs(spark, corpus), s).count()
    assert len(s.kept) == 1
    left = [p for p in Path(s.path.removeprefix("file:")).iterdir() if any(p.glob("*.parquet"))]
    assert len(left) == 1


def test_empty_table(spark):
    assert minhash.near_duplicates(nothing(spark), Scratch(spark, "t")).count() == 0
    assert minhash.drop_near_duplicates(nothing(spark), Scratch(spark, "t")).count() == 0
