"""Specs, reading and cleaning of answers, exploding, merging, evaluation."""

from __future__ import annotations

import json
import random
from collections import Counter

import pandas as pd
import pytest
import yaml
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loomwork import spec as S
from loomwork.errors import ConfigError, SourceError
from loomwork.functions import conditions
from loomwork.operators import answers as A
from loomwork.operators import evaluation, prompts, results
from pyspark.sql import functions as F
from pyspark.sql import types as T

V = S.Variable
ALL = S.SimpleSpec((V("s"), V("n", data_type="number"), V("i", data_type="integer"), V("b", data_type="boolean"), V("l", data_type="[string]"), V("m", data_type="[integer]"), V("d", data_type="date")))
BOOKS = S.NestedSpec((V("title", required=True), V("sold", data_type="integer"), V("genres", data_type="[string]", allowed_values=("Novel", "Poetry"))), "books")
BOTH = S.MultipleSpec((("who", S.SimpleSpec((V("name", required=True), V("age", data_type="integer")))), ("books", BOOKS)))


def read(spark, answers: list, spec: S.Spec):
    rows = spark.createDataFrame([(i, a if isinstance(a, str) or a is None else json.dumps(a)) for i, a in enumerate(answers)], "i int, a string")
    return [(r.x.asDict(True) if r.x is not None else None, r.e) for r in rows.select("i", A.read(F.col("a"), spec).alias("x"), A.read_error(F.col("a"), spec).alias("e")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [
        ("n", "5", 5.0), ("n", 5, 5.0), ("n", True, 1.0), ("n", "x", ...), ("n", None, None), ("i", 5.0, 5), ("i", 5.5, ...), ("i", "7", 7), ("i", True, 1), ("i", "7.0", 7),
        ("b", "yes", True), ("b", "OFF", False), ("b", 1, True), ("b", 0, False), ("b", 2, ...), ("s", 5, ...), ("s", "a", "a"), ("s", ["a"], ...),
        ("l", ["a", None], ...), ("l", ["a", "b"], ["a", "b"]), ("l", [], []), ("l", None, []), ("l", "a", ...), ("m", ["1", 2.0], [1, 2]), ("m", [1.5], ...), ("d", "2020-01-01", "2020-01-01"),
    ],
)
def test_lax_reading(spark, field, value, want):
    ((got, error),) = read(spark, [{field: value, "unknown": 1}], ALL)
    if want is ...:
        assert got is None and error == "doesn't fit the spec"
    else:
        assert error is None and got[field] == want and all(v in (None, []) for k, v in got.items() if k != field)


def test_what_cannot_be_read(spark):
    got = read(spark, ["not json", None, "[1]", "{}"], ALL)
    assert [e for _, e in got] == ["not JSON", "no answer", "doesn't fit the spec", None]


def test_nested_and_multiple_reading(spark):
    good = {"who": {"name": "A", "age": "3"}, "books": {"books": [{"title": "T", "genres": ["Novel"]}, {"title": None}]}}
    got = read(spark, [good, {"who": {"name": 1}, "books": {"books": []}}, {"who": {"name": "A"}, "books": {}}, {"who": {"name": "A"}}], BOTH)
    assert got[0][0]["who"] == {"name": "A", "age": 3} and [b["title"] for b in got[0][0]["books"]["books"]] == ["T", None]
    assert got[1][0] is None and got[2][0]["books"]["books"] == [] and got[3][0] is None


def clean(spark, answer: dict, spec: S.Spec, text: str = "", stringify: bool = False):
    df = spark.createDataFrame([(json.dumps(answer), text)], "a string, t string")
    x = A.clean(A.read(F.col("a"), spec), spec, F.col("t"), stringify)
    return json.loads(df.select(A.to_json(x)).first()[0])


def test_cleaning(spark):
    spec = S.SimpleSpec((V("a", required=True), V("b", allowed_values=("x", "none")), V("c", data_type="[string]", validate_in_text=True), V("d", data_type="integer", allowed_values=(1, 2.0, True, "3")), V("e", data_type="number", validate_in_text=True)))
    assert clean(spark, {"a": "v", "b": "None", "c": ["One", "two", "none"], "d": 2, "e": 5}, spec, "ONE and 5.0") == {"a": "v", "b": None, "c": ["One"], "d": 2, "e": None}
    assert clean(spark, {"a": "v", "e": 5}, spec, "5.0", stringify=True)["e"] == 5.0
    assert clean(spark, {"a": "N/A"}, spec) == {}
    assert clean(spark, {"b": "none", "a": "v", "d": 3}, spec) == {"a": "v", "b": "none", "c": [], "d": None, "e": None}


def test_nested_cleaning(spark):
    items = [{"title": "A", "genres": ["Novel", "Essay"]}, {"title": "unknown"}, {"sold": 3}]
    assert clean(spark, {"books": items}, BOOKS) == {"books": [{"title": "A", "sold": None, "genres": ["Novel"]}]}
    assert clean(spark, {"books": items[1:]}, BOOKS) == {}
    assert clean(spark, {"who": {"name": ""}, "books": {"books": items}}, BOTH) == {"who": None, "books": [{"title": "A", "sold": None, "genres": ["Novel"]}]}


def test_cleaning_is_idempotent(spark):
    answer = {"books": [{"title": "A", "sold": 1, "genres": ["Novel", "x"]}, {"title": "none"}]}
    once = clean(spark, answer, BOOKS)
    assert clean(spark, once, BOOKS) == once


def test_problems_of_expected_answers(spark):
    spec = S.SimpleSpec((V("n", data_type="number", required=True), V("l", data_type="[string]"), V("d", data_type="date")))
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate([{"n": 1.5, "l": ["a"], "d": 3}, {"n": 1}, {"l": "a", "n": 2.5}, {"l": [1], "n": 2.5}, {}])] + [(5, "x")], "i int, a string")
    got = [r.p for r in df.select("i", A.problems(F.col("a"), spec).alias("p")).orderBy("i").collect()]
    assert got[0] == [] and "not a number" in got[1][0] and "not a list" in got[2][0] and "root.l[]" in got[3][0] and got[4] == ["root.n: missing"] and got[5] == ["root: not JSON"]


def test_specs_from_dicts_and_files(tmp_path):
    d = {"schema_type": "multiple", "who": {"variables": [{"name": "a", "data_type": ["string"], "required": True}]}, "many": {"schema_type": "nested", "container_name": "items", "variables": [{"name": "b", "data_type": "mystery"}]}}
    spec = S.from_dict(d)
    assert spec.spark_type == T.StructType().add("who", T.StructType().add("a", T.ArrayType(T.StringType()), True, {"description": "", "required": True})).add("many", spec.specs[1][1].spark_type)
    assert spec.specs[1][1].item_type["b"].dataType == T.StringType() and spec.cleaned_type["many"].dataType == T.ArrayType(spec.specs[1][1].item_type)
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(d, sort_keys=False))
    (tmp_path / "s.json").write_text(json.dumps(d))
    assert S.load(tmp_path / "s.yaml") == S.load(tmp_path / "s.json") == spec
    assert S.load(tmp_path / "s.yaml").required() == {"who.a": True, "many.items.b": False}
    (tmp_path / "s.txt").write_text("x")
    for bad in (lambda: S.load(tmp_path / "s.txt"), lambda: S.from_dict({"schema_type": "what"})):
        with pytest.raises(ConfigError):
            bad()
    S.register("alias", lambda x: S.SimpleSpec(()))
    assert "alias" in S.kinds() and S.from_dict({"schema_type": "alias"}) == S.SimpleSpec(())


def test_prompts(spark):
    spec = S.SimpleSpec((V("a", "what", required=True, allowed_values=("x", "y")), V("b", "which", "[integer]")))
    df = spark.createDataFrame([("a {text} {variables} b",)], "t string")
    got = df.select(prompts.prompt(F.col("t"), spec, "V:\n{variables}\n{other}T: {text}")).first()[0]
    assert got == 'V:\n- a: what (string) [REQUIRED] (allowed values: "x", "y")\n- b: which ([integer])\n{other}T: a {text} {variables} b'
    multi = df.select(prompts.prompt(F.lit("t"), S.MultipleSpec((("one", spec), ("two", spec))), "{text}|{context}", {"k": 1})).first()[0]
    assert multi == "## ONE\nt|{'k': 1}\n\n## TWO\nt|{'k': 1}"


# exploding and merging


def test_explode(spark):
    df = spark.createDataFrame([(1, [("A", 1, ["Novel"]), ("B", None, [])]), (2, None), (3, [])], "id int, books array<struct<title:string,sold:bigint,genres:array<string>>>")
    df = df.select("id", F.struct("books").alias("extracted"))
    assert sorted(map(tuple, results.explode(df, BOOKS).collect())) == [(1, "A", 1, ["Novel"]), (1, "B", None, [])]
    with pytest.raises(SourceError):
        results.explode(df, BOOKS, "other")


def test_explode_takes_both_shapes(spark):
    wrapped = spark.createDataFrame([("x", [("T", 1, [])])], "n string, b array<struct<title:string,sold:bigint,genres:array<string>>>")
    who = F.struct(F.col("n").alias("name"), F.lit(None).cast("bigint").alias("age")).alias("who")
    a = results.explode(wrapped.select(F.struct(who, F.struct(F.col("b").alias("books")).alias("books")).alias("extracted")), BOTH)
    b = results.explode(wrapped.select(F.struct(who, F.col("b").alias("books")).alias("extracted")), BOTH)
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([None, "a", "b", "c"])), min_size=1, max_size=60))
def test_majority(spark, rows):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g int, v string, o int").repartition(3)
    want = {}
    for g in {g for g, _ in rows}:
        values = [v for h, v in rows if h == g and v is not None]
        if values:
            want[g] = max(values, key=lambda v: (Counter(values)[v], -values.index(v)))
    assert {r.g: r.top for r in results.majority(df, ["g"], F.col("v"), "o", "top").collect()} == want
    spec = S.SimpleSpec((V("v"),))
    merged = results.merge(df.select("g", "o", F.struct("v").alias("extracted")), spec, by="g", order="o")
    assert {r.g: r.extracted.v for r in merged.collect()} == {g: want.get(g) for g, _ in rows}


def test_merge_of_every_kind(spark):
    deep = S.MultipleSpec((("top", BOTH), ("tags", S.SimpleSpec((V("t", data_type="[string]"),)))))
    answer = lambda n, title, t: {"top": {"who": {"name": n, "age": None}, "books": [{"title": title, "sold": 1, "genres": []}] if title else []}, "tags": {"t": t}}
    rows = [(1, 2, answer("B", "T2", ["y"])), (1, 1, answer("A", "T1", ["x", "x"])), (1, 3, answer("B", None, [])), (2, 1, None), (None, 4, answer("Z", "Z", []))]
    schema = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("extracted", deep.cleaned_type)])
    got = {r.r: r.extracted.asDict(True) for r in results.merge(spark.createDataFrame(rows, schema), deep, by="r", order="c").collect()}
    assert got[1]["top"]["who"]["name"] == "B" and [b["title"] for b in got[1]["top"]["books"]] == ["T1", "T2"] and got[1]["tags"]["t"] == ["x", "x", "y"]
    assert set(got) == {1, 2} and got[2]["tags"]["t"] == [] and got[2]["top"]["who"]["name"] is None


def test_canonical_json(spark):
    kind = T.StructType().add("b", T.IntegerType()).add("a", T.ArrayType(T.StructType().add("d", T.IntegerType()).add("c", T.IntegerType())))
    df = spark.createDataFrame([((1, [(2, None)]),)], T.StructType().add("x", kind))
    assert df.select(results.canonical_json(F.col("x"), kind)).first()[0] == '{"a":[{"c":null,"d":2}],"b":1}'


# evaluation


def plain_counts(pairs: list[tuple[dict, dict]]) -> dict[str, list[int]]:
    """The rules for a nested spec, in plain Python: whole items, then each field over all items."""
    total: dict[str, list[int]] = {}

    def count(field, t, p):
        x = total.setdefault(field, [0, 0, 0])
        for k, n in enumerate((len(t & p), len(p - t), len(t - p))):
            x[k] += n

    for t, p in pairs:
        if t is None or p is None or not (t["books"] or p["books"]):
            continue
        whole = lambda d: {json.dumps(i, sort_keys=True) for i in d["books"]}
        if t["books"]:
            count("books", whole(t), whole(p))
        for f in ("title", "sold"):
            values = lambda d, f=f: {i[f] for i in d["books"]} - {None}
            if f == "title" or values(t):  # title is required
                count(f"books.{f}", values(t), values(p))
    return total


def test_metrics_of_items(spark):
    rng = random.Random(3)
    spec = S.NestedSpec((V("title", required=True), V("sold", data_type="integer")), "books")
    item = lambda: {"title": rng.choice("ABCDE"), "sold": rng.choice([1, 2, None])}
    pairs = [({"books": [item() for _ in range(rng.randrange(4))]}, {"books": [item() for _ in range(rng.randrange(4))]}) for _ in range(60)]
    kind = T.StructType().add("k", T.IntegerType()).add("expected", spec.spark_type).add("extracted", spec.spark_type)
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], kind)
    got = {r.field: r for r in evaluation.micro_average(evaluation.counts(df, spec)).collect()}
    want = plain_counts(pairs)
    assert {f: [r.tp, r.fp, r.fn] for f, r in got.items()} == want
    r = got["books.title"]
    assert r.precision == pytest.approx(r.tp / (r.tp + r.fp)) and r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall))


def test_metrics_of_scalars(spark):
    spec = S.SimpleSpec((V("need", required=True), V("may"), V("tags", data_type="[string]")))
    kind = T.StructType().add("k", T.IntegerType()).add("expected", spec.spark_type).add("extracted", spec.spark_type)
    rows = [
        (1, {"need": "a", "may": None, "tags": ["x", "y"]}, {"need": "a", "may": "extra", "tags": ["y", "z"]}),
        (2, {"need": "a", "may": "b", "tags": []}, {"need": None, "may": None, "tags": ["q"]}),
        (3, {"need": "", "may": "b", "tags": None}, {"need": "n", "may": "b", "tags": ["q"]}),
    ]
    got = {r.field: (r.tp, r.fp, r.fn) for r in evaluation.micro_average(evaluation.counts(spark.createDataFrame(rows, kind), spec)).collect()}
    assert got == {"need": (1, 1, 1), "may": (1, 0, 1), "tags": (1, 1, 1)}


# query strings

QUERIES = ["a > 1", "a != 2", "a in [1, 3]", "a not in [1, 3]", "0 < a <= 2 and s == 'x'", "(a == 1) | ~(s == 'x')", "not a > 1", "a + 1 >= 3", "`b c` < 2", "s == 'x & y | z'", "a % 2 == 1", "a == [1, 2]", "a * -1 < -1"]


@pytest.mark.parametrize("q", QUERIES)
def test_query_strings_mean_what_a_data_frame_means(spark, q):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, None], "s": ["x", "x & y | z", "y", "x"], "b c": [1.0, 2.0, 3.0, 0.5], "i": [0, 1, 2, 3]})
    df = spark.createDataFrame([(None if pd.isna(r[0]) else r[0], *r[1:]) for r in pdf.itertuples(index=False)], "a double, s string, `b c` double, i int")
    assert sorted(r.i for r in conditions.query(df, q).collect()) == sorted(pdf.query(q).i)


@pytest.mark.parametrize("q", ["a >", "unknown > 1", "__import__('os')", "a.b > 1", "a > 1; a", "[x for x in a]", "a if s else 1", ""])
def test_bad_query_strings(spark, q):
    with pytest.raises(ConfigError):
        conditions.query(spark.createDataFrame([(1, "s")], "a int, s string"), q)


def test_an_answer_is_parsed_once(spark):
    """However many fields a spec has, and with its error."""
    spec = S.SimpleSpec(tuple(S.Variable(f"v{i}", data_type=t) for i, t in enumerate(("number", "integer", "boolean", "[string]", "string"))))
    df = spark.createDataFrame([('{"v0": "1.5", "v1": 2.0, "v2": 1, "v3": ["a"], "v4": "b"}',), ('{"v1": 2.5}',), ("{",), (None,)], "j string")
    out = df.select(A.read_or_error(F.col("j"), spec).alias("r"), A.read(F.col("j"), spec).alias("v"), A.read_error(F.col("j"), spec).alias("e"))
    assert all(r.r.value == r.v and r.r.error == r.e for r in out.collect())
    assert [r.e for r in out.collect()] == [None, "doesn't fit the spec", "not JSON", "no answer"]
    plan = df.select(A.read_or_error(F.col("j"), spec).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2
