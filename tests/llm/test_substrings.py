from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from loomwork.llm import substrings
from loomwork.llm.store import Scratch

from .common import awkward, docs, letter_words, nothing, text


def brute_force(rows, window: int) -> set:
    """Maximal runs of words whose every window occurs elsewhere too, apart for first occurrences and others."""
    at = defaultdict(list)
    for i, t in rows:
        w = letter_words(t or "")
        for j in range(len(w) - window + 1):
            at[tuple(w[j : j + window])].append((i, j))
    marks = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            first = min(places)
            for i, j in places:
                marks[i, (i, j) == first].add(j)
    out = set()
    for (i, first), js in marks.items():
        run: list[int] = []
        for j in sorted(js):
            if run and j > run[-1] + 1:
                out.add((i, run[0], run[-1] + window, first))
                run = []
            run.append(j)
        out.add((i, run[0], run[-1] + window, first))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    shared = [text(rng, n) for n in (55, 60, 130)]
    rows = []
    for i in range(80):
        parts = [text(rng, rng.randrange(0, 80))]
        for s in shared:
            if rng.random() < 0.3:
                parts += [s, text(rng, rng.randrange(0, 40))]
        rows.append((i, " ".join(parts)))
    rows.append((200, shared[2] + " " + shared[2]))  # within one document
    rows.append((201, " ".join(["again"] * 120)))  # overlapping itself
    return rows


def found(df) -> set:
    return {(r.doc_id, r.start_word, r.end_word, r.first) for r in df.collect()}


@pytest.mark.parametrize("window", [50, 20])
def test_matches_brute_force(spark, corpus, window):
    out = substrings.repeated_passages(docs(spark, corpus), Scratch(spark, "t"), window)
    assert found(out) == brute_force(corpus, window)


def test_a_small_sketch_loses_nothing(spark, corpus):
    out = substrings.repeated_passages(docs(spark, corpus), Scratch(spark, "t"), n_cells=1 << 16)
    assert found(out) == brute_force(corpus, substrings.WINDOW)


def test_sketch_never_underestimates(spark, corpus):
    bits = substrings.sketch(docs(spark, corpus), 50, 1 << 16, Scratch(spark, "t"))
    import pyarrow as pa
    from loomwork.llm import kernels as K

    seen = defaultdict(int)
    for _, t in corpus:
        r = substrings.runs(*K.flat(pa.array([t.lower()])), 50)
        for m in r[0].tolist() if r else []:
            seen[m] += 1
    often = np.array([m for m, n in seen.items() if n > 1], np.uint64)
    assert len(often) and substrings._flagged(bits, often).all()


def test_hot_minimiser_is_held_by_window(spark, corpus, monkeypatch):
    """A minimiser of very many occurrences isn't kept in memory whole."""
    g = substrings._Grouping(50)
    rng = np.random.default_rng(0)
    monkeypatch.setattr(substrings, "HELD_ROWS", 100)
    rows, said = [], []
    h = rng.integers(0, 40, 1000).astype(np.uint64)
    for lo in range(0, 1000, 50):
        rows += [(lo + k, int(h[lo + k])) for k in range(50)]
        for b in g.add(np.full(50, 7, np.uint64), np.arange(lo, lo + 50), np.zeros(50, bool), np.zeros(50, np.int64), h[lo : lo + 50]):
            said += b.to_pylist()
        assert len(g.m) <= 190
    said += g.emit(np.zeros(len(g.m), bool)).to_pylist()
    assert sorted(r["doc_id"] for r in said) == list(range(1000))
    first = {}
    for i, x in rows:
        first.setdefault(x, i)
    assert {r["doc_id"] for r in said if r["first"]} == set(first.values())


def test_awkward_rows(spark):
    df = awkward(spark)
    got = {(r.doc_id, r.first) for r in substrings.repeated_passages(df, Scratch(spark, "t")).collect()}
    # the same text: null, 1 twice, 2, and -4, which is least; 11 repeats itself
    ids = {i for i, _ in got}
    assert ids == {None, 1, 2, -4, 11}


def test_empty_table(spark):
    assert substrings.repeated_passages(nothing(spark), Scratch(spark, "t")).count() == 0
