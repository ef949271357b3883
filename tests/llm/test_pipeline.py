"""The corpus pipeline: each stage on its own input, and the whole."""

from __future__ import annotations

import random
import re

import corpus_pipeline as P
import duckdb
import numpy as np
import pytest
from loomwork.llm import kernels as K
from loomwork.llm import minhash, queries

from .common import SCHEMA, awkward, docs, letter_words, nothing, text, words
from .test_lines import brute_force, bucket_links, same_beginnings
from .test_minhash import jaccard, least_of_all_pairs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, path, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A corpus of which is known what should come of it."""
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(400):
        if i % 5 == 4:
            t = " ".join("%%## " + rng.choice(["BUY", "NOW", "FREE"]) for _ in range(60))
        else:
            t = text(rng, 150)
        rows.append((i, t))
        labels.append((i, int(i % 5 != 4), 0))
    rows += [(1000, rows[0][1]), (1001, rows[1][1].replace("w", "v", 1) + " end")]
    rows += [(1002, text(rng, 60) + " mail to some.one@example.org please " + text(rng, 60))]
    return write(spark, tmp_path_factory.mktemp("small") / "sf", rows, labels), dict(rows)


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "pii", "packing"]


def test_every_stage_keeps_the_columns_and_its_decisions_count(spark, small):
    sf, text_of = small
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else docs.collect()
    good = {i for i in text_of if i % 5 != 4 or i >= 1000}
    assert set(kept["quality_classifier"]) <= set(text_of)
    assert len(good - set(kept["quality_classifier"])) <= 2 and len(set(kept["quality_classifier"]) - good) <= 2
    assert 1000 not in kept["line_dedup"]  # every line of it is an earlier one's
    assert set(kept["near_duplicates"]) <= set(kept["line_dedup"])
    assert set(kept["pii"]) == set(kept["near_duplicates"])
    assert "some.one@example.org" not in kept["pii"][1002] and "[EMAIL]" in kept["pii"][1002]
    want = " ".join(kept["pii"][i] for i in sorted(kept["pii"])).split()
    windows = sorted(kept["packing"], key=lambda r: (r.shard, r.window))
    assert " ".join(r.text for r in windows).split() == want


def test_near_duplicates_by_themselves(spark, small):
    sf, _ = small
    rng = random.Random(32)
    base = [text(rng, 200) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace(" ", "  ", 3)) for i, t in enumerate(base[:10])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = P.near_duplicates(spark, df, sf)
    assert {r.doc_id for r in out.collect()} == set(range(30))


def test_run_is_the_stages_one_after_another(spark, small):
    sf, _ = small
    a = P.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(repr, a)) == sorted(map(repr, docs.collect()))


def test_run_against_plain_python(spark, small):
    """All pairs of lines, all pairs of documents, a rule for addresses, and the words of all windows in order; of the classifier its decisions are taken."""
    sf, _ = small
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in P.quality_classifier(spark, docs, sf).collect()]
    left = {i: t for i, t in brute_force(rows).items() if t is not None}
    gone = {b for a in left for b in left if a < b and jaccard(left[a], left[b]) >= 0.55}
    want = [re.sub(r"[\w.]+@[\w.]+\w", "[EMAIL]", left[i]) for i in sorted(set(left) - gone)]
    windows = P.run(spark, sf).orderBy("shard", "window").collect()
    assert " ".join(r.text for r in windows).split() == " ".join(want).split()
    assert all(r.n_tokens <= 1024 or r.truncated == r.n_tokens - 1024 for r in windows)


def test_awkward_rows_go_through_every_stage(spark, small):
    sf, _ = small
    docs = awkward(spark)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0


def test_empty_table_through_every_stage(spark, small):
    sf, _ = small
    docs = nothing(spark)
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema)


def test_registered_queries():
    names = list(queries.QUERIES)
    assert [re.match(r"op(\d+)_", n).group(1) for n in names] == [str(i) for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(names)


def test_top_k_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op9_top_k_search"])
    names = [c[0] for c in cur.description]
    got = queries.QUERIES["op9_top_k_search"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_fixtures_have_words():
    rng = random.Random(1)
    assert len(letter_words(text(rng, 77))) == 77 and len(words(rng, 5)) == 5


def test_line_dedup_loses_no_pair_of_a_bucket(spark):
    texts = same_beginnings()
    got = {r.text for r in P.line_dedup(spark, docs(spark, list(enumerate(texts))), "").collect()}
    assert got == set(bucket_links(texts).values())


def test_near_duplicates_loses_no_pair_of_a_bucket(spark):
    """Documents of one long beginning, in which many bands meet, and chains of ends."""
    rng = random.Random(33)
    same, rows = words(rng, 60), []
    for _ in range(70):
        w = words(rng, 60)
        for _ in range(6):
            for _ in range(rng.randrange(7)):
                w[rng.randrange(60)] = words(rng, 1)[0]
            rows.append(" ".join(same + w))
    rng.shuffle(rows)
    df = docs(spark, list(enumerate(dict.fromkeys(rows))))
    sigs = {r.doc_id: np.frombuffer(r.sig, np.uint16) for r in minhash.signatures(df).collect()}
    ids = sorted(sigs)
    buckets: dict[int, list[int]] = {}
    for i, keys in zip(ids, K.band_keys(np.stack([sigs[i] for i in ids]), minhash.BANDS, minhash.WIDTH).tolist(), strict=True):
        for k in keys:
            buckets.setdefault(k, []).append(i)
    gone = least_of_all_pairs(buckets, lambda x, y: (sigs[x] == sigs[y]).mean() >= minhash.THRESHOLD)
    kept = {r.doc_id for r in P.near_duplicates(spark, df, "").select("doc_id").collect()}
    assert kept == set(ids) - set(gone) and 50 < len(kept) < len(ids), (len(kept), len(ids) - len(gone), len(ids))
