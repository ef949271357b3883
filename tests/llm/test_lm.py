from __future__ import annotations

import functools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from loomwork.llm import kernels as K
from loomwork.llm import lm
from loomwork.llm.store import Scratch
from pyspark.sql import functions as F

from .common import awkward, docs, nothing, text, words

BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def split(t: str) -> list[str]:
    for c in BLANKS:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def test_seating_follows_the_restaurant_process():
    """Mean number of tables against customers seated one by one."""
    rng, d, s, base, n = np.random.default_rng(0), 0.7, 1.0, 0.2, 24
    cells = 4000
    got = lm.seat(rng, np.full(cells, n), np.arange(cells), np.full(cells, base), np.zeros(cells), np.zeros(cells), d, s)
    want = []
    for _ in range(4000):
        t = 1
        for j in range(1, n):
            new, old = (s + d * t) * base, j - d * t
            t += rng.random() < new / (new + old)
        want.append(t)
    assert got.mean() == pytest.approx(np.mean(want), rel=0.03)
    assert got.min() >= 1 and got.max() <= n


def test_large_groups_are_close_to_one_by_one(monkeypatch):
    rng, d, s, base, n, cells = np.random.default_rng(1), 0.7, 1.0, 0.3, 400, 1500
    args = (np.full(cells, n), np.arange(cells), np.full(cells, base), np.zeros(cells), np.zeros(cells), d, s)
    fast = lm.seat(rng, *args).mean()
    monkeypatch.setattr(lm, "ONE_BY_ONE", 10_000)
    assert fast == pytest.approx(lm.seat(rng, *args).mean(), rel=0.05)


def test_probabilities_of_a_context_sum_to_one():
    """Over all 256 bytes after a context, those that were never seen included."""
    rng = np.random.default_rng(2)
    x = rng.integers(97, 101, 4000).astype(np.uint64)
    g, n = np.unique(x[2:] | x[1:-1] << np.uint64(8) | x[:-2] << np.uint64(16), return_counts=True)
    d, s = 0.7, 1.0
    levels, up = lm.build(g, n, 2, 0)
    base = np.full(len(levels[-1].cells), 1 / 256)
    lm.sample_chain(levels, up, base, 4, 1, rng, d, s, lambda: None)

    def p(ctx: tuple[int, ...], w: int) -> float:
        k = len(ctx)
        level = levels[2 - k]
        parent = 1 / 256 if not k else p(ctx[1:], w)
        code = 0
        for c in ctx:
            code = code << 8 | c
        room = np.searchsorted(level.contexts, np.uint64(code))
        if room == len(level.contexts) or level.contexts[room] != code:
            return parent
        c, t = (x[room] for x in level.sums())
        at = np.flatnonzero((level.room == room) & ((level.cells & np.uint64(255)) == w))
        cw, tw = (level.c[at[0]], level.t[at[0]]) if len(at) else (0, 0)
        return (cw - d * tw + (s + d * t) * parent) / (s + c)

    for ctx in [(97, 98), (100, 100), (120, 97), ()]:
        assert sum(p(ctx, w) for w in range(256)) == pytest.approx(1, abs=1e-9)
    # customers of a parent are the tables of its children
    assert levels[1].c.sum() == levels[0].t.sum()


def test_spelling_is_the_trigrams_of_padded_words():
    texts = ["ab cde", "", "x", "ü  y"]
    data, off = K.flat(pa.array(texts))
    t, _ = lm.words(data, off)
    g, word = lm.spelling(data, t.start, t.end)
    want = []
    for i, w in enumerate(x for s in texts for x in split(s)):
        b = b"  " + w.encode() + b" "
        want += [(int.from_bytes(b[k - 2 : k + 1], "big"), i) for k in range(2, len(b))]
    assert list(zip(g.tolist(), word.tolist(), strict=True)) == want


def test_packed_comes_back():
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0, np.uint64), np.array([1, 1 << 31], np.uint32)]
    for a, b in zip(arrays, lm.unpacked(lm.packed(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_floats_of_24_bits():
    x = np.array([0.0, -1.0, -3.14159, -60_000.5, -1e30, -1e-3])
    assert lm.from_24(lm.to_24(x)) == pytest.approx(x, rel=2**-16)
    at = np.array([0, 3, 3, 70, 59_999])
    assert np.cumsum(lm.steps(at).astype(np.int64)).tolist() == at.tolist()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, text(rng, 150)) for i in range(60)] + [(100, "".join(chr(rng.randrange(33, 126)) for _ in range(900)))]
    return out + [(200, out[0][1]), (201, out[1][1] + " more of it"), (202, "to be or not to be " * 20)]


def speller_of(spark, df) -> lm.Speller:
    t = lm.count(df, 1).where("key >= 0").toPandas()
    return lm.Speller(t.key.to_numpy().view(np.uint64), t.n.to_numpy())


def plain(rows, speller, fold_of, tables) -> dict[int, float]:
    """The model in plain Python: restaurants of words with `tables(c)` tables for c customers, without what the text itself sent."""
    d, s = lm.DISCOUNT, lm.STRENGTH
    dishes: dict[str, Counter] = defaultdict(Counter)
    for _, t in rows:
        for v, w in zip(["", *split(t)], split(t)):
            dishes[v][w] += 1
    out = {}
    for i, t in rows:
        own: dict[str, Counter] = defaultdict(Counter)
        for v, w in zip(["", *split(t)], split(t)):
            own[v][w] += 1
        total = 0.0
        for v, mine in own.items():
            left = {w: c - mine[w] for w, c in dishes[v].items()}
            t_left = {}
            for w, c in dishes[v].items():
                k = tables(c)
                t_left[w] = k if not mine[w] else 0 if not left[w] else min(max(k * (left[w] / c) ** d, 1), left[w])
            present, all_t = sum(left.values()), sum(t_left.values())
            for w, n in mine.items():
                data = np.frombuffer(w.encode(), np.uint8)
                base = math.exp(speller.words(data, np.array([0]), np.array([len(data)]), np.array([1 - fold_of[i]], np.uint64))[0])
                p = (left[w] - d * t_left[w] + (s + d * all_t) * base) / (s + present)
                total += n * math.log(p) if p > 0 else -math.inf
        out[i] = total
    return out


def test_scores_are_those_of_plain_python(spark, rows, monkeypatch):
    rows = [r for r in rows if r[0] != 100]  # noise spells words that are too improbable for plain numbers
    tables = lambda c: math.ceil(c**0.6)
    monkeypatch.setattr(lm, "seat", lambda rng, c, *_: np.ceil(c**0.6).astype(np.int64))
    df = docs(spark, rows)
    fold_of = {r.doc_id: r.t & 1 for r in df.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    want = plain(rows, speller_of(spark, df), fold_of, tables)
    speller = speller_of(spark, df)
    t1 = np.array([r.t for r in df.select(F.xxhash64("text").alias("t")).collect()]).view(np.uint64)
    b, w, sp, doc = lm.occurrences(pa.array([t for _, t in rows]), t1, speller, K.Lookup(np.zeros(0, np.uint64)), np.zeros(0, np.int64))
    got = lm.score_room(b, w, sp, doc, np.ones(len(rows), np.int64), 1)
    assert got.tolist() == pytest.approx([want[i] for i, _ in rows], rel=1e-6)
    # copies that are sent once and weighted are the same
    once = {t: i for i, t in reversed(rows)}
    keep = np.array([once[t] == i for i, t in rows])
    weight = np.array([sum(u == t for _, u in rows) for _, t in rows])[keep]
    number = np.cumsum(keep) - 1
    mine = keep[doc]
    again = lm.score_room(b[mine], w[mine], sp[mine], number[doc[mine]], weight, 1)
    assert again.tolist() == pytest.approx([want[i] for (i, _), k in zip(rows, keep, strict=True) if k], rel=1e-6)


def scores(spark, rows, **how) -> dict:
    return {r.doc_id: r for r in lm.score(docs(spark, rows), Scratch(spark, "t"), **how).collect()}


def test_many_rooms_and_chunks_give_what_one_gives(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "seat", lambda rng, c, *_: np.ceil(c**0.6).astype(np.int64))
    a = scores(spark, rows)
    monkeypatch.setattr(lm, "ROOM_BYTES", 3000)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 5000)
    b = {r.doc_id: r for r in lm.score(docs(spark, rows).repartition(5), Scratch(spark, "t")).collect()}
    assert a.keys() == b.keys() and all(a[i].log_prob == pytest.approx(b[i].log_prob, rel=1e-4) for i in a)


def test_noise_is_more_perplexing_than_text_and_a_twin_less(spark, rows):
    got = scores(spark, rows)
    usual = [r.perplexity for i, r in got.items() if 2 <= i < 60]
    assert got[100].perplexity > 2 * max(usual)
    assert got[0].log_prob == got[200].log_prob and got[0].perplexity < 0.5 * min(usual)
    assert got[1].perplexity < 0.5 * min(usual) and got[201].perplexity < 0.5 * min(usual)
    assert all(r.perplexity == pytest.approx(np.exp(-r.log_prob / r.n_bytes), rel=1e-3) for r in got.values())


def test_known_words_in_random_order_are_more_perplexing(spark):
    rng = random.Random(9)
    vocabulary = words(rng, 300)
    after = {w: rng.sample(vocabulary, 6) for w in vocabulary}

    def sentence(n: int) -> list[str]:
        out = [rng.choice(vocabulary)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    texts = [sentence(120) for _ in range(80)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(1000 + i, " ".join(rng.sample(w, len(w)))) for i, w in enumerate(texts[:10])]
    got = scores(spark, rows)
    assert max(got[i].perplexity for i in range(80)) < min(got[1000 + i].perplexity for i in range(10))


def test_hot_words_have_several_rooms(spark, rows, monkeypatch):
    a = scores(spark, rows)
    monkeypatch.setattr(lm, "ROOM_WORDS", 40)
    b = scores(spark, rows)
    assert a.keys() == b.keys() and a[0].log_prob != b[0].log_prob
    assert b[0].log_prob == b[200].log_prob  # equal texts are in one room
    assert all(a[i].log_prob == pytest.approx(b[i].log_prob, rel=0.15) for i in a)


def test_a_hot_word_has_one_restaurant(spark, monkeypatch):
    """In many rooms or in one, predictions are those of all customers: they differ by no more than other draws make them."""
    rng = random.Random(19)
    vocabulary = words(rng, 40)
    texts = [" ".join(rng.choice(vocabulary[: 3 + i % 37]) for _ in range(60)) for i in range(80)]
    rows = [*enumerate(texts), (100, texts[5]), (101, texts[7]), (102, "")]
    apart = lambda x, y: np.mean([abs(x[i].log_prob / y[i].log_prob - 1) for i in range(80)])
    a = scores(spark, rows)
    with monkeypatch.context() as m:
        m.setattr(lm, "in_rooms", functools.partial(lm.in_rooms, seed=99))
        noise = apart(a, scores(spark, rows))
    monkeypatch.setattr(lm, "ROOM_WORDS", 40)
    monkeypatch.setattr(lm, "ROOM_BYTES", 3000)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    df = docs(spark, rows).repartition(5)
    b = {r.doc_id: r for r in lm.score(df, Scratch(spark, "t")).collect()}
    assert a.keys() == b.keys() and b[5].log_prob == b[100].log_prob
    assert apart(a, b) < 2 * noise < 0.05, (apart(a, b), noise)


def test_rooms_are_told_of_all_customers(spark):
    """What hot_seats tells, against counts over all texts."""
    rng = random.Random(20)
    vocabulary = words(rng, 30)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(60)] * 2
    pairs = Counter(p for t in texts for p in zip(split(t), split(t)[1:]))
    df = docs(spark, list(enumerate(texts))).repartition(4)
    named = lambda w: int(lm.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])
    hot = vocabulary[:6]
    keys = np.array([named(w) | 1 << 63 for w in hot], np.uint64)
    parts = lm.hot_parts(df, speller_of(spark, df), K.Lookup(keys), np.full(len(hot), 5), 7)
    word = {named(w) >> 41 << 1 | 1: w for w in vocabulary}
    place = {(r.room, int(lm.unpacked(r.cells)[0][0])): hot[r.hot] for r in parts.collect()}
    seen = Counter()
    for r in lm.hot_seats(parts, keys).collect():
        v, w, c, n_all, *seats = lm.unpacked(r.known)
        before = place[r.room, int(v[0])]
        seen[before] += 1
        of_all = {y: n for (x, y), n in pairs.items() if x == before}
        assert n_all[0] == sum(of_all.values()) and [of_all[word[int(x)]] for x in w] == c.tolist()
        assert len(seats) == 2 * (lm.SWEEPS - lm.BURN_IN) and all(((t > 0) & (t <= c)).all() for t in seats[::2])
    assert set(seen) == set(hot) and min(seen.values()) > 1


def test_counts_are_those_of_the_whole_corpus(spark, rows):
    want: Counter = Counter()
    for _, t in rows:
        for w in split(t):
            b = b"  " + w.encode() + b" "
            want.update(int.from_bytes(b[k - 2 : k + 1], "big") for k in range(2, len(b)))
    got: Counter = Counter()
    for r in lm.count(docs(spark, rows), 1).collect():
        assert r.key >= 0
        got[r.key & 0xFFFFFF] += r.n
    assert got == want


def test_spellings_are_distributions(spark, rows):
    """The probabilities of all bytes after a context sum to one: seen contexts, unseen ones, and seen ones whose suffix matters."""
    speller = speller_of(spark, docs(spark, rows))
    for ctx in (b"w1", b"  ", b"zz", b"~!", b" w"):
        g = np.array([int.from_bytes(ctx + bytes([w]), "big") for w in range(256)], np.uint64)
        for fold in (0, 1):
            assert np.exp(speller.log_probs(g, np.full(256, fold, np.uint64))).sum() == pytest.approx(1, abs=0.02), (ctx, fold)


def test_the_result_does_not_hang_on_partitions(spark, rows):
    a = lm.score(docs(spark, rows), Scratch(spark, "t")).collect()
    b = lm.score(docs(spark, rows), Scratch(spark, "t")).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = lm.score(df, Scratch(spark, "t")).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.perplexity is None) == (r.n_bytes == 0)
        assert r.log_prob <= 0
    assert len({r.log_prob for r in rows if r.doc_id in (1, 2)}) == 1
    assert [r.log_prob for r in rows if r.doc_id in (3, 4, 5)] == [0, 0, 0]


def test_empty_table(spark):
    assert lm.score(nothing(spark), Scratch(spark, "t")).count() == 0
