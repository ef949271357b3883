from __future__ import annotations

import random

import pytest
from loomwork.llm import fingerprints as fp
from loomwork.llm.store import Scratch
from pyspark.sql import functions as F

from .common import awkward, docs, letter_words, nothing, text


def shingles(t: str, k: int = fp.SHINGLE) -> set:
    w = letter_words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    part = text(rng, 400)
    return {0: part, 1: text(rng, 6000) + " " + part + " " + text(rng, 6000), 2: text(rng, 3000), 3: part[: len(part) // 2]}


def test_sketch_is_a_fixed_fraction_of_the_shingles(spark, texts):
    got = {r.doc_id: r.sketch for r in fp.sketches(docs(spark, list(texts.items()))).collect()}
    for i, t in texts.items():
        n = len(shingles(t))
        assert abs(len(got[i]) - n / fp.SCALED) < 5 * (n / fp.SCALED) ** 0.5
        assert got[i] == sorted(set(got[i]), key=lambda x: x % (1 << 64))
    # with no scaling the sketch is the set itself
    all_ = {r.doc_id: len(r.sketch) for r in fp.sketches(docs(spark, list(texts.items())), scaled=1).collect()}
    assert all_ == {i: len(shingles(t)) for i, t in texts.items()}


def test_containment_of_unequal_documents(spark, texts):
    s = fp.sketches(docs(spark, list(texts.items())))
    pairs = s.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")).crossJoin(s.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")))
    got = {(r.a, r.b): r.c for r in pairs.select("a", "b", fp.containment("sa", "sb").alias("c")).collect()}
    for (a, b), c in got.items():
        x, y = shingles(texts[a]), shingles(texts[b])
        assert c == pytest.approx(len(x & y) / len(x), abs=0.12)


def test_sketch_of_a_union_is_the_union(spark, texts):
    s = fp.sketches(docs(spark, list(texts.items()))).withColumn("g", F.lit(1))
    (merged,) = fp.merge(s, "g").collect()
    assert set(merged.sketch) == {h for r in s.collect() for h in r.sketch}


def test_query_matches_brute_force(spark, texts):
    items = spark.createDataFrame([(70, texts[0]), (71, "never seen anywhere at all in the corpus here"), (72, None)], "item_id bigint, text string")
    rows = list(texts.items()) + [(0, texts[2][:500])]
    out = {r.doc_id: r for r in fp.fingerprints(docs(spark, rows), items, Scratch(spark, "t")).collect()}
    sketch = {i: set(r.sketch) for i, r in out.items()}
    assert sorted(out) == [0, 1, 2, 3]
    for i, r in out.items():
        others = set().union(*(s for j, s in sketch.items() if j != i))
        assert r.in_others == pytest.approx(len(sketch[i] & others) / len(sketch[i]), abs=1e-6)
        assert r.n_shingles == len(r.sketch) * fp.SCALED
    assert out[0].items == [70] and out[1].items == [70] and out[2].items == []


def test_short_items_are_matched_on_all_their_shingles(spark, monkeypatch):
    rng = random.Random(18)
    passages = {i: text(rng, 16) for i in range(80)}
    held = {i: text(rng, 300) + " " + t + " " + text(rng, 300) for i, t in passages.items()}
    # one word at the end of each is another
    edited = {100 + i: text(rng, 100) + " " + " ".join([*letter_words(t)[:-1], "changed"]) for i, t in passages.items()}
    # and only one shingle is shared
    slight = {200 + i: text(rng, 100) + " " + " ".join(letter_words(t)[: fp.SHINGLE]) for i, t in passages.items()}
    items = spark.createDataFrame(list(passages.items()), "item_id bigint, text string")
    df = docs(spark, [*held.items(), *edited.items(), *slight.items()])
    want = {i: [i % 100] if i < 200 else [] for i in [*held, *edited, *slight]}
    assert {r.doc_id: r["items"] for r in fp.fingerprints(df, items, Scratch(spark, "t")).collect()} == want
    monkeypatch.setattr(fp, "BROADCAST_HASHES", -1)
    assert {r.doc_id: r["items"] for r in fp.fingerprints(df, items, Scratch(spark, "t")).collect()} == want


def test_repeated_rows_and_items_of_twelve_words(spark):
    """An item counts once however often its row is there: half of an item isn't the item; and all of 200 short items that are quoted whole are found."""
    rng = random.Random(19)
    passages = {i: text(rng, 12) for i in range(200)}
    half = {i: text(rng, 40) for i in range(1000, 1020)}
    rows = {i: text(rng, 100) + " " + t + " " + text(rng, 100) for i, t in passages.items()}
    rows |= {i: text(rng, 100) + " " + " ".join(letter_words(t)[:22]) for i, t in half.items()}
    items = spark.createDataFrame(list(passages.items()) + list(half.items()) * 3, "item_id bigint, text string")

    def share(i: int, item: str) -> float:
        x, y = shingles(item), shingles(rows[i])
        return len(x & y) / len(x)

    got = {r.doc_id: r["items"] for r in fp.fingerprints(docs(spark, list(rows.items())), items, Scratch(spark, "t")).collect()}
    assert {i for i, found in got.items() if i in found} == set(passages)
    assert all(got[i] == [] and 0.3 < share(i, half[i]) < 0.6 for i in half)


def test_awkward_rows(spark):
    df = awkward(spark)
    items = spark.createDataFrame([(1, None), (None, "two words"), (3, "")], "item_id bigint, text string")
    out = fp.fingerprints(df, items, Scratch(spark, "t")).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) == df.select("doc_id").distinct().count()
    blank = [r for r in out if r.doc_id in (3, 4, 5, 6)]
    assert all(r.sketch == [] and r.in_others is None and r.n_shingles == 0 for r in blank) and len(blank) == 4
    same = [r for r in out if r.doc_id in (1, 2)]
    assert all(r.in_others == 1.0 for r in same)


def test_empty_tables(spark):
    assert fp.fingerprints(nothing(spark), spark.createDataFrame([], "item_id bigint, text string"), Scratch(spark, "t")).count() == 0
