"""The whole way, costs, the cache, streams, plans."""

from __future__ import annotations

import json
import random
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from loomwork import pipeline as P
from loomwork import plans, streaming
from loomwork.errors import ConfigError, StoreError
from loomwork.functions.score import KeywordScorer
from loomwork.functions.text import RegexSplit
from loomwork.operators import cache, costs, extraction, keywords
from loomwork.operators.extraction import Rules
from loomwork.sources.store import Store
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPEC = {"variables": [{"name": "name", "required": True}, {"name": "fruit", "data_type": "[string]"}]}
CONFIG = {
    "llm_extraction": {"provider": "openai", "name": "gpt-4o-mini", "batch_size": 2, "max_workers": 3, "max_retries": 1, "base_delay": 0.0},
    "data_preprocessing": {"target_column": "t", "splitting": {"type": "RegexSplit", "pattern": ";"}, "scoring": {"type": "KeywordScorer", "keywords": ["likes"]}, "pandas_score_filter": "score > 0.5"},
    "schema": {"spec": SPEC, "prompt_template": "{text}"},
}
RULES = Rules({"name": r"(\w+) likes", "fruit": r"(apple|plum|fig)"})


def changed(**sections):
    return {k: CONFIG.get(k, {}) | sections.get(k, {}) for k in CONFIG.keys() | sections.keys()}


@pytest.fixture
def source(spark):
    return spark.createDataFrame([(10, "Ann likes apple; nothing; Ann likes plum", "x"), (20, "Bob likes fig", "y"), (30, "likes nobody", "z")], "k bigint, t string, m string")


def test_rules_end_to_end(spark, source):
    run = P.Pipeline(spark, CONFIG, RULES)
    chunks = run.prep_data(source)
    assert chunks.count() == 4
    out = {r.chunk_id: r for r in run.process().collect()}
    assert [json.loads(out[i].extracted_json) for i in sorted(out)] == [{"name": "Ann", "fruit": ["apple"]}, {"name": "Ann", "fruit": ["plum"]}, {"name": "Bob", "fruit": ["fig"]}, {}]
    assert all(r.errors is None and r.m in "xyz" for r in out.values())
    (s,) = run.run_summary().collect()
    assert (s.records, s.chunks, s.chunks_with_errors) == (3, 4, 0)
    (c,) = run.cost_summary().collect()
    assert c.total_cost == pytest.approx(c.input_tokens * 0.6e-6 + c.output_tokens * 2.4e-6) and c.input_tokens > 0


def test_callable_with_errors_and_retries(spark, source):
    def answer(prompt: str):
        if "Bob" in prompt:
            raise ValueError("no Bob")
        return {"name": prompt.split()[0], "fruit": [prompt.split()[-1]]}

    run = P.Pipeline(spark, changed(data_preprocessing={"pandas_score_filter": None}), answer)
    run.prep_data(source)
    out = {r.chunk: r for r in run.process().collect()}
    assert json.loads(out["Bob likes fig"].errors) == ["ValueError: no Bob"] and out["Bob likes fig"].extracted_json is None
    assert out["Ann likes plum"].extracted.fruit == ["plum"]
    assert out["nothing"].extracted.name == "nothing"


def test_answers_that_do_not_fit(spark, source):
    run = P.Pipeline(spark, CONFIG, lambda p: {"name": 5} if "Bob" in p else "no json")
    run.prep_data(source)
    assert {json.loads(r.errors)[0] for r in run.process().collect()} == {"doesn't fit the spec", "not JSON"}


def test_cache_asks_once(spark, source, tmp_path):
    log = tmp_path / "asked"

    def answer(prompt: str):
        with log.open("a") as f:
            f.write(prompt + "\n")
        return {"name": "N", "fruit": []}

    config = changed(semantic_cache={"path": str(tmp_path / "cache")})
    twice = source.union(source)
    for _ in range(2):
        run = P.Pipeline(spark, config, answer)
        run.prep_data(twice)
        assert run.process().count() == 8
    assert sorted(log.read_text().split("\n")) == ["", "Ann likes apple", "Ann likes plum", "Bob likes fig", "likes nobody"]
    assert run.cost_summary().first().input_tokens == 0
    assert run.cache.stats().first().entries == 4


def test_budget(spark):
    df = spark.createDataFrame([(i, "x" * 400 + " likes") for i in range(10)], "k bigint, t string")
    run = P.Pipeline(spark, changed(llm_extraction={"max_budget": 350 * 0.6e-6}), RULES)
    run.prep_data(df)
    out = [(r.chunk_id, r.batch_id, r.errors) for r in run.process().orderBy("chunk_id").collect()]
    tokens = run.results().where("errors is null").count()
    assert out[-1][2] is None or json.loads(out[-1][2]) == ["Over budget"]
    assert 2 <= tokens < 10 and len(out) % 2 == 0


def test_resume_answers_what_is_missing(spark, source, tmp_path):
    log = tmp_path / "asked"

    def answer(prompt: str):
        with log.open("a") as f:
            f.write(prompt + "\n")
        return {"name": "N", "fruit": []}

    store = Store(spark, str(tmp_path / "run"))
    run = P.Pipeline(spark, CONFIG, answer, store)
    run.prep_data(source)
    run.process()
    done = run.results().where("batch_id = 0")
    # as if the run had ended after the first batch
    key = extraction.cache_key(F.col("chunk"), run.config.schema.system_prompt, "openai/gpt-4o-mini", 0.0)
    rows = done.select("chunk_id", "batch_id", "chunk", "extracted", "extracted_json", "errors", "tokens_in", "tokens_out", key.alias("key"))
    store.save_batches(spark.createDataFrame(rows.collect(), rows.schema))
    shutil.rmtree(tmp_path / "run" / "results")
    log.write_text("")
    again = P.Pipeline(spark, CONFIG, answer, Store(spark, str(tmp_path / "run")), resume=True)
    assert again.process().count() == 4
    assert sorted(log.read_text().strip().split("\n")) == ["Bob likes fig", "likes nobody"]
    with pytest.raises(StoreError, match="completed"):
        P.Pipeline(spark, CONFIG, answer, Store(spark, str(tmp_path / "run")), resume=True)


def test_resume_asks_no_saved_prompt_again(spark, tmp_path):
    """Batches of two, of which the first was saved; the other two have its prompts, and one of their own."""
    texts = ["Ann likes fig", "Bob likes fig", "Bob likes fig", "Ann likes fig", "Ann likes fig", "Cy likes fig"]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, t string")
    store = Store(spark, str(tmp_path / "run"))
    run = P.Pipeline(spark, CONFIG, lambda p: {"name": p.split()[0], "fruit": []} if p[0] == "A" else 1 / 0, store)
    run.prep_data(df)
    saved, n = store.save_batches, []

    def breaks(rows):
        if n:
            raise InterruptedError
        n.append(saved(rows))

    store.save_batches = breaks
    with pytest.raises(InterruptedError):
        run.process(wave=1)
    out = P.Pipeline(spark, CONFIG, lambda p: {"name": "again", "fruit": []}, Store(spark, store.path), resume=True).process(wave=1)
    got = [(r.batch_id, r.extracted and r.extracted.name, r.errors and "ZeroDivisionError" in r.errors) for r in out.orderBy("chunk_id").collect()]
    a, b = ("Ann", None), (None, True)
    assert got == [(0, *a), (0, *b), (1, *b), (1, *a), (2, *a), (2, "again", None)]


def test_preprocessed_data_and_samples(spark, source, tmp_path):
    path = str(tmp_path / "chunks.parquet")
    spark.createDataFrame([(0, "Zoe likes fig")], "chunk_id bigint, chunk string").write.parquet(path)
    run = P.Pipeline(spark, {"schema": CONFIG["schema"], "data_preprocessing": {"preprocessed_data_path": path}}, RULES)
    run.prep_data("")
    assert run.process().first().extracted.name == "Zoe"
    run = P.Pipeline(spark, CONFIG, RULES)
    assert run.prep_data(source, sample_size=1).select("record_id").distinct().count() == 1


def test_evaluation(spark, source):
    expected = spark.createDataFrame([(10, '{"name": "Ann", "fruit": ["apple", "fig"]}'), (20, '{"name": "Rob", "fruit": ["fig"]}'), (99, '{"name": "X"}')], "k bigint, expected_json string")
    got = {r.field: (r.tp, r.fp, r.fn) for r in P.estimate_performance(spark, CONFIG, RULES, source, expected, "k").collect()}
    assert got == {"name": (1, 1, 1), "fruit": (2, 1, 1)}


def test_total_cost_estimate(spark, source):
    (r,) = P.estimate_total_cost(spark, CONFIG, RULES, source, 2).collect()
    assert r.records == 3 and r.sampled == 2 and r.estimate == pytest.approx(r.spent * 1.5)


def test_unknown_prices(spark):
    with pytest.raises(ConfigError):
        P.Pipeline(spark, changed(llm_extraction={"name": "no-such-model"}), RULES)
    P.Pipeline(spark, changed(llm_extraction={"name": "no-such-model", "track_cost": False}), RULES)
    assert costs.price("X", "y", (1.0, 2.0)) == (1.0, 2.0)


# pieces


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def call(p):
        calls.append(p)
        if len(calls) < 4:
            raise RuntimeError("again")
        return "ok"

    assert extraction.with_retry(call, "p", 3, 1.0, waits.append) == ("ok", 4) and waits == [1.0, 2.0, 4.0]
    calls.clear()
    with pytest.raises(RuntimeError):
        extraction.with_retry(call, "p", 1, 0.0, waits.append)


def test_threads_keep_the_order(spark):
    def call(p):
        time.sleep(0.05 * (int(p) % 3))
        return {"v": p}

    df = spark.createDataFrame([(str(i), str(i)) for i in range(12)], "key string, prompt string").coalesce(1)
    out = extraction.Caller(call, threads=8).ask(df).collect()
    assert [(r.key, json.loads(r.answer)["v"]) for r in out] == [(str(i), str(i)) for i in range(12)]


@pytest.mark.parametrize("seed", range(5))
def test_budget_gate_against_a_simulation(spark, seed):
    rng = random.Random(seed)
    cost, budget, size = [rng.randrange(0, 9) for _ in range(60)], rng.randrange(0, 250), rng.choice([1, 4, 7])
    want, spent = {}, 0
    for lo in range(0, 60, size):
        if spent > budget:
            break
        for i in range(lo, min(60, lo + size)):
            want[i] = spent > budget
            spent += cost[i]
    df = spark.createDataFrame(list(enumerate(cost)), "chunk_id bigint, c bigint").repartition(4)
    # the costs of refused calls aren't spent, but all that follow are refused as well
    assert {r.chunk_id: r.over for r in costs.budget_gate(df, "c", budget, size, block=16).collect()} == want


def test_cache_table(spark, tmp_path):
    c = cache.AnswerCache(spark, str(tmp_path / "c"), max_mb=1)
    assert c.read().count() == 0 and c.stats().first().entries == 0
    c.compact()
    c.add(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    c.add(spark.createDataFrame([("a", "3")], "key string, value string"))
    assert {r.key: r.value for r in c.read().collect()} == {"a": "3", "b": "2"}
    c.compact()
    assert c.table().count() == 2
    old = spark.createDataFrame([("k%d" % i, "v", i * 1800, 10) for i in range(40)], "key string, value string, s bigint, bytes bigint").selectExpr("key", "value", "timestamp_seconds(s) as ts", "bytes")
    assert sorted(r.key for r in cache.prune(old, 55).collect()) == ["k35", "k36", "k37", "k38", "k39"]


def test_coverage_is_that_of_each_list(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abcdef") for _ in range(6)), rng.random() < 0.4, rng.randrange(1, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "chunk string, y boolean, c bigint")
    words = ["ab", "C", "ff"]
    got = {r.keywords: r for r in keywords.coverage(df, words, F.col("y"), F.col("c")).collect()}
    for n in range(4):
        hit = [r for r in rows if any(w.lower() in r[0] for w in words[:n])]
        assert got[n].selected == len(hit) and got[n].coverage == pytest.approx(sum(r[1] for r in hit) / sum(r[1] for r in rows))
        assert got[n].saving == pytest.approx(1 - sum(r[2] for r in hit) / sum(r[2] for r in rows))


# streams


def stream_of(spark, tmp_path, batches, schema):
    path = tmp_path / "in"
    path.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_stream_equals_table(spark, tmp_path):
    docs = [[(1, "a cat\ndog"), (2, None)], [(3, "cat\n\nCAT x")]]
    s = stream_of(spark, tmp_path, docs, "record_id bigint, t string")
    out = streaming.run_to_table(streaming.prepare(s, "t", RegexSplit("\n"), KeywordScorer(("cat",)), "score > 0"), str(tmp_path / "out"))
    assert sorted((r.record_id, r.pos, r.chunk) for r in out.collect()) == [(1, 0, "a cat"), (3, 0, "cat"), (3, 1, "CAT x")]


def test_stateful_majority(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[("u", "a"), ("v", "z")], [("u", "b"), ("u", "b"), (None, "q"), ("w", None)]], "k string, x string")
    out = streaming.run_to_table(streaming.majority(s, "k", F.col("x")), str(tmp_path / "out"), "update")
    last = out.groupBy("key").agg(F.max_by("value", "batch").alias("value"), F.max_by("n", "batch").alias("n"))
    assert {r.key: (r.value, r.n) for r in last.collect()} == {"u": ("b", 2), "v": ("z", 1)}


def test_sessions(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[("u", 0), ("u", 600), ("u", 9000)]], "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    out = streaming.run_to_table(streaming.session_counts(s, "ts", ["k"]), str(tmp_path / "out"), "complete")
    assert sorted(r.n for r in out.collect()) == [1, 2]


def test_streamed_extraction_uses_the_cache(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[("k1", "p1"), ("k2", "p2")], [("k1", "p1"), ("k3", "p3")]], "key string, prompt string")
    c, store, log = cache.AnswerCache(spark, str(tmp_path / "c")), Store(spark, str(tmp_path / "s")), tmp_path / "log"

    def call(p):
        with log.open("a") as f:
            f.write(p + "\n")
        return p.upper()

    w = streaming.extract(s, extraction.Caller(call).ask, c, store.keep, lambda df: df.select("key", "answer", "hit"), str(tmp_path / "out"), str(tmp_path / "cp"))
    w.trigger(availableNow=True).start().awaitTermination()
    assert sorted(log.read_text().split()) == ["p1", "p2", "p3"]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.where("hit").count() == 1


# plans


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    from loomwork.operators import chunks as C

    lines = C.prepare(df, "text", RegexSplit("\n"), KeywordScorer(("x",)), "score > 0.5", ids=False, record_id="doc_id", drop_target=True).where("lang = 'en'").select("doc_id", "chunk")
    plan = plan_of(lines)
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan.split("ReadSchema")[1] and "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["keyword_lines_by_language", "sentence_windows_5_2", "clean_values", "merge_records", "field_metrics", "lax_coercion", "keyword_discovery", "budget_gate", "cache_prune"])
def test_native_queries_have_no_python(spark, name):
    plan = plan_of(plans.QUERIES[name](spark, SF))
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan


def test_theta_join_makes_no_pairs(spark, tmp_path):
    """Equal and null balances are no pairs, and customers aren't joined with suppliers."""
    spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None), (2, 1.0)], "c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 5.0), (1, 6.0), (1, 7.0), (1, None), (2, 0.0)], "s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, "a"), (2, "b")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    out = plans.QUERIES["theta_join"](spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [("a", 4)]
    assert plan_of(out).split("Initial Plan")[0].count("Join") == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lang", "chunks", "docs"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
