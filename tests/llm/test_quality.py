from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from loomwork.llm import kernels as K
from loomwork.llm import quality

from .common import awkward, docs, nothing

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def halves():
    d, y = pq.read_table(f"{SF}/documents.parquet"), pq.read_table(f"{SF}/labels.parquet").to_pandas().drop_duplicates("doc_id")
    text = dict(zip(d["doc_id"].to_pylist(), d["text"].to_pylist(), strict=True))
    y["text"] = y.doc_id.map(text)
    y = y[y.text.notna()].drop_duplicates("text")
    half = (y.doc_id % 2 == 0).to_numpy()
    return y[half], y[~half]


def test_held_out_accuracy(halves):
    train, test = halves
    model = quality.fit(pa.array(train.text, pa.string()), train.quality.to_numpy(float), train.toxic.to_numpy(float))
    s = quality._scores(model, pa.array(test.text, pa.string()))
    right = lambda p, y: ((p > 0.5) == (y > 0.5)).mean()
    q, t = test.quality.to_numpy(), test.toxic.to_numpy()
    assert right(s["q"], q) > 0.98 and right(s["t"], t) > 0.97
    keep, clean = quality._keep(s, 0.5, 0.5), (q == 1) & (t == 0)
    assert keep[clean].mean() > 0.985  # clean ones stay
    assert keep[~clean].mean() < 0.04  # bad and toxic ones are caught
    assert (s["t"][(q == 1) & (t == 1)] > 0.5).mean() > 0.96


def test_gradients_are_those_of_the_loss():
    texts = pa.array(["good words here " * 30, "bad bad thing " * 50, "good thing", "bad here"])
    data, off = K.flat(texts)
    b = quality.bags(data, off)
    model = quality.Model(np.unique(b.word), 3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y = {"q": np.array([1.0, 0, 1, 0]), "t": np.array([0.0, 1, 0, 1])}
    row, keep = model.rows(b.word), np.ones(len(b.word), bool)

    def loss() -> float:
        h = model.encode(row, b.word_at, b.shape)
        out = 0.0
        for head in "qt":
            p = model.attend(h, b.first, head)[0]
            out -= np.mean(y[head] * np.log(p) + (1 - y[head]) * np.log(1 - p))
        return out

    g = model.gradients(row, b.word_at, b.shape, b.first, y, keep)
    rng = np.random.default_rng(0)
    for k, x in model.p.items():
        at = tuple(rng.integers(0, s) for s in x.shape)
        old, e = x[at], 1e-5
        x[at] = old + e
        up = loss()
        x[at] = old - e
        down = loss()
        x[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-4), k


def test_attention_weighs_passages():
    texts = pa.array(["fine words " * 200 + "awful " * 32 + "fine words " * 200 if i % 2 else "fine words " * 416 for i in range(200)])
    y = np.arange(200) % 2
    model = quality.fit(texts, np.ones(200), y.astype(float), epochs=6)
    data, off = K.flat(texts.slice(0, 2))
    b = quality.bags(data, off)
    row = model.rows(b.word)
    score, weights = model.attend(model.encode(row[row >= 0], b.word_at[row >= 0], b.shape), b.first, "t")[:2]
    assert score[0] < 0.5 < score[1]
    a = weights[b.first[1] : b.first[2]]
    assert a.argmax() in (12, 13) and a.sum() == pytest.approx(1, abs=1e-5)
    assert model.constant["q"] == 1.0  # one class only: rejects nothing


def test_bags_of_whole_texts_in_slices(monkeypatch):
    texts = pa.array(["one two three. " * 100, None, "", "FOUR five", "six " * 333])
    data, off = K.flat(texts)
    whole = quality.bags(data, off)
    monkeypatch.setattr(K, "SLICE_BYTES", 64)
    words, seen = quality._document_counts(data, off)
    assert len(words) == 4 + 2 + 1 and seen.tolist() == [1] * 7  # thre- and three are two
    model = quality.Model(words[1:])
    row, at, shape, first = quality._known_bags(model, data, off)
    want = model.rows(whole.word)
    assert np.array_equal(row, want[want >= 0]) and np.array_equal(at, whole.word_at[want >= 0])
    assert np.array_equal(shape, whole.shape) and np.array_equal(first, whole.first)
    assert np.diff(whole.first).tolist() == [10, 0, 0, 1, 11]


def test_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 0, None), (None, 1, 1), (99, 0, 0), (8, 1, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(df, labels)
    out = quality.score(df, model)
    assert out.count() == df.count()
    blank = out.where("doc_id in (3, 4, 5)").collect()
    assert len(blank) == 3 and all(r.quality is None and r.toxic is None and r.keep for r in blank)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == out.where("keep").count()


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.train(nothing(spark), labels)
    assert quality.score(nothing(spark), model).count() == 0
    assert quality.keep_good(docs(spark, [(1, "a text")]), model).count() == 1


def test_sample_is_bounded_and_fixed(spark):
    df = docs(spark, [(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    a = {r._d for r in quality.sample(df, labels, 10).collect()}
    assert len(a) == 10 and a == {r._d for r in quality.sample(df.repartition(3), labels.repartition(7), 10).collect()}
