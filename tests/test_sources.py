"""Readers, the store, configurations."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
import pytest
import yaml
from loomwork.config import Config
from loomwork.errors import ConfigError, MissingDependency, SourceError, StoreError
from loomwork.operators import chunks as C
from loomwork.sources import readers, writers
from loomwork.sources.store import MemoryStore, Store, differences

from .test_text import docx


def xlsx(rows: list[list]) -> bytes:
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: list[str] = []

    def cell(n: int, i: int, v) -> str:
        at = f"{chr(65 + i)}{n}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    body = "".join(f"<row>{''.join(cell(n + 1, i, v) for i, v in enumerate(row))}</row>" for n, row in enumerate(rows))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}">{"".join(f"<si><t>{s}</t></si>" for s in shared)}</sst>')
    return raw.getvalue()


def rows(df):
    return sorted(map(tuple, df.drop("record_id").collect()))


def test_whole_texts(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.txt").write_bytes("one\ntwo é".encode())
    (d / "b.TXT").write_bytes(b"bad \xff byte")
    (d / ".DS_Store").write_text("x")
    df = readers.load(spark, str(d))
    assert rows(df) == [("a.txt", "one\ntwo é"), ("b.TXT", "bad � byte")]
    assert sorted(r.record_id for r in df.collect()) == [0, 1]
    (tmp_path / "m.md").write_text("# head")
    assert rows(readers.load(spark, str(tmp_path / "m.md"), "body")) == [("m.md", "# head")]
    assert "body" in readers.load(spark, str(tmp_path / "m.md"), "body").columns


def test_html_and_docx(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>a</p><p>b &amp; c</p>")
    assert rows(readers.load(spark, str(tmp_path / "p.html"))) == [("p.html", "a\nb & c")]
    d = tmp_path / "w"
    d.mkdir()
    (d / "good.docx").write_bytes(docx())
    (d / "broken.docx").write_bytes(b"no zip")
    assert rows(readers.load(spark, str(d))) == [("good.docx", "top\nfirst\nsecond\ncell\nbottom")]
    with pytest.raises(Exception, match="(?i)zip"):
        readers.load(spark, str(d / "broken.docx")).collect()


def test_empty_and_null_texts_come_back_from_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, '"'), (4, " a\n"), (None, "b")], "k int, text string")
    writers.write_csv(df, str(tmp_path / "d"))
    got = readers.load(spark, str(tmp_path / "d"), "text")
    assert {(r.k, r.text) for r in got.collect()} == {tuple(r) for r in df.collect()}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a ""quoted""\n\nline"\n2,\n')
    df = readers.load(spark, str(tmp_path / "a.csv"), "text")
    assert sorted(map(tuple, df.select("id", "text").collect())) == [(1, 'a "quoted"\n\nline'), (2, None)]
    d = tmp_path / "many"
    d.mkdir()
    (d / "x.csv").write_text("text,age\nhi,3\n")
    (d / "y.csv").write_text("text,name\nho,ann\n")
    (d / "z.csv").write_text("text,age\nhu,4\n")
    got = readers.load(spark, str(d), "text")
    assert sorted(map(str, (r.asDict() for r in got.select("text", "age", "name").collect()))) == sorted(map(str, [{"text": "hi", "age": 3, "name": None}, {"text": "hu", "age": 4, "name": None}, {"text": "ho", "age": None, "name": "ann"}]))
    with pytest.raises(SourceError, match="age, name|text"):
        readers.load(spark, str(d), "nope")
    with pytest.raises(SourceError):
        readers.load(spark, str(d))


def test_parquet_feather_excel(spark, tmp_path):
    pdf = pd.DataFrame({"text": ["a", None], "n": [1, 2]})
    pdf.to_parquet(tmp_path / "t.parquet")
    assert rows(readers.load(spark, str(tmp_path / "t.parquet"), "text").select("n")) == [(1,), (2,)]
    d = tmp_path / "f"
    d.mkdir()
    pdf.to_feather(d / "a.feather")
    pd.DataFrame({"text": ["b"], "x": [0.5]}).to_feather(d / "b.feather")
    (d / "c.feather").write_bytes(b"broken")
    got = readers.load(spark, str(d), "text").select("text", "n", "x").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 1, None), (None, 2, None), ("b", None, 0.5)]))
    (tmp_path / "s.xlsx").write_bytes(xlsx([["text", "n", "x", "b"], ["hi", 1, 2.5, True], ["5", None, 3, False]]))
    df = readers.load(spark, str(tmp_path / "s.xlsx"), "text")
    assert dict(df.dtypes) | {"record_id": "bigint"} == {"text": "string", "n": "bigint", "x": "double", "b": "boolean", "record_id": "bigint"}
    assert rows(df.select("text", "x", "b")) == [("5", 3.0, False), ("hi", 2.5, True)]


def test_what_cannot_be_loaded(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.md").write_text("x")
    with pytest.raises(SourceError, match="several kinds"):
        readers.load(spark, str(tmp_path))
    with pytest.raises(SourceError, match="no reader.*\\.csv"):
        (tmp_path / "q").mkdir()
        (tmp_path / "q" / "x.zip").write_text("x")
        readers.load(spark, str(tmp_path / "q"))
    (tmp_path / "e").mkdir()
    for path in ("e", "missing.csv"):
        with pytest.raises(SourceError):
            readers.load(spark, str(tmp_path / path))
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="register_converter"):
        readers.load(spark, str(tmp_path / "p.pdf")).collect()


def test_registration(spark, tmp_path):
    before = dict(readers.LOADERS)
    try:
        readers.register_converter(".pdf", lambda raw: raw.decode().upper())
        (tmp_path / "p.pdf").write_bytes(b"text")
        assert rows(readers.load(spark, str(tmp_path / "p.pdf"))) == [("p.pdf", "TEXT")]
        readers.register(".rows", lambda s, p, folder: s.read.csv(p, schema="text string"), needs_target=True)
        (tmp_path / "r.rows").write_text("a\nb\n")
        assert rows(readers.load(spark, str(tmp_path / "r.rows"), "text")) == [("a",), ("b",)]
        assert readers.needs_target(".CSV") and not readers.needs_target(".txt") and ".rows" in readers.supported()
    finally:
        readers.LOADERS.clear()
        readers.LOADERS.update(before)
    assert issubclass(MissingDependency, ImportError)


def test_data_frames_are_sources(spark):
    df = spark.range(10).selectExpr("id as k", "cast(id as string) as t").repartition(3)
    got = readers.load(spark, df, "t")
    assert sorted(r.record_id for r in got.collect()) == list(range(10))
    with pytest.raises(SourceError):
        readers.load(spark, df, "x")


# chunks


def test_chunks(spark):
    from loomwork.functions.score import KeywordScorer
    from loomwork.functions.text import RegexSplit

    df = spark.createDataFrame([(5, "a,b,cat", 1), (2, "", 2), (9, None, 3), (7, "dog", 4)], "record_id bigint, t string, m int")
    out = C.prepare(df, "t", RegexSplit(","), KeywordScorer(("CAT", "b")), None)
    got = [(r.record_id, r.chunk_id, r.pos, r.chunk, r.score, r.m) for r in out.orderBy("chunk_id").collect()]
    assert got == [(2, 0, 0, None, None, 2), (5, 1, 0, "a", 0.0, 1), (5, 2, 1, "b", 1.0, 1), (5, 3, 2, "cat", 1.0, 1), (7, 4, 0, "dog", 0.0, 4), (9, 5, 0, None, None, 3)]
    kept = C.prepare(df, "t", RegexSplit(","), KeywordScorer(("CAT", "b")), "score >= 0.5", drop_target=True)
    assert "t" not in kept.columns and [r.chunk_id for r in kept.orderBy("chunk_id").collect()] == [2, 3]
    assert [r.batch_id for r in C.batches(kept, 1).orderBy("chunk_id").collect()] == [0, 1]
    whole = C.chunk(df, "t", None)
    assert "t" not in whole.columns and whole.count() == 4
    with pytest.raises(ConfigError):
        C.chunk(df, "t", None, drop_target=True)


def test_dense_ids_over_blocks(spark):
    df = spark.createDataFrame([(k * 7 - 50, k % 3) for k in range(40)], "k bigint, x int").repartition(5)
    got = C.dense_ids(df, "n", "k", block=10).orderBy("k").collect()
    assert [r.n for r in got] == list(range(40))


# store


@pytest.fixture(params=["folder", "memory"])
def store(request, spark, tmp_path):
    s = Store(spark, str(tmp_path / "run")) if request.param == "folder" else MemoryStore(spark)
    s.initialise({"a": 1}, {"b": 2})
    return s


def test_batches_and_results(spark, store):
    df = spark.range(25).selectExpr("id as chunk_id", "id div 10 as batch_id")
    with pytest.raises(StoreError):
        store.batches()
    store.save_batches(df)
    assert store.batch_ids() == [0, 1, 2] and store.load_batch(2).count() == 5 if store.path != "memory:" else store.batch_ids() == [0, 1, 2]
    store.save_batches(spark.createDataFrame([(99, 1)], "chunk_id bigint, batch_id bigint"))
    assert store.batches().count() == 16
    assert store.delete_batch(0) and not store.delete_batch(7)
    assert store.batch_ids() == [1, 2]
    store.save_state({"x": 1})
    assert not store.is_completed()
    store.save_results(df)
    assert store.is_completed() and store.results().count() == 25
    store.save_chunks(df)
    assert store.load_chunks().count() == 25
    store.cleanup()
    assert store.batch_ids() == [] and store.state() == {"x": 1}


def test_what_is_saved_at_once_is_one_folder(spark, tmp_path):
    s = Store(spark, str(tmp_path / "run"))
    s.initialise({}, {})
    s.save_batches(spark.range(5000).selectExpr("id as chunk_id", "id div 10 as batch_id"))
    assert len(list((tmp_path / "run" / "batches").iterdir())) == 1 and len(s.batch_ids()) == 500
    s.delete_batch(3)
    s.save_batches(spark.createDataFrame([(7, 3), (8, 4)], "chunk_id bigint, batch_id bigint"))
    assert s.batches().count() == 4982 and s.load_batch(3).count() == 1 and s.load_batch(4).count() == 1


def test_initialising(spark, tmp_path):
    path = str(tmp_path / "run")
    Store(spark, path).initialise({"a": {"x": 1}}, {})
    with pytest.raises(StoreError, match="exists"):
        Store(spark, path).initialise({"a": {"x": 1}}, {})
    Store(spark, path).initialise({"a": {"x": 1}}, {}, resume=True)
    with pytest.raises(StoreError, match="config.a.x"):
        Store(spark, path).initialise({"a": {"x": 2}}, {}, resume=True)
    s = Store(spark, path)
    s.save_results(spark.range(1))
    with pytest.raises(StoreError, match="completed"):
        Store(spark, path).initialise({"a": {"x": 1}}, {}, resume=True)
    Store(spark, path).initialise({"a": {"x": 2}}, {}, overwrite=True)
    assert not s.is_completed()
    with pytest.raises(StoreError):
        MemoryStore(spark).initialise({}, {}, resume=True)


def test_differences():
    assert differences({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"b": 2, "c": [1]}, "e": 1}) == ["a.b", "d", "e"]


# configurations


def test_configuration(tmp_path):
    d = {
        "llm_extraction": {"provider": "openai", "name": "gpt-4o-mini", "max_budget": 1.5},
        "data_preprocessing": {"target_column": "t", "splitting": {"type": "ParagraphSplit"}, "scoring": {"type": "KeywordScorer", "keywords": ["a"]}, "pandas_score_filter": "score > 0"},
        "schema": {"spec": {"variables": [{"name": "a"}]}},
        "semantic_cache": {"backend": "sqlite", "path": "x"},
    }
    c = Config.from_dict(d)
    assert Config.from_dict(c.to_dict()) == c and Config.from_any(c) is c and c.llm_extraction.model == "openai/gpt-4o-mini"
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(d))
    (tmp_path / "c.json").write_text(json.dumps(d))
    assert Config.from_any(str(tmp_path / "c.yaml")) == Config.from_any(tmp_path / "c.json") == c


@pytest.mark.parametrize(
    ("section", "key", "value"),
    [
        ("llm_extraction", "temperature", 3), ("llm_extraction", "max_retries", -1), ("llm_extraction", "batch_size", 0), ("llm_extraction", "max_workers", 0), ("llm_extraction", "base_delay", -1),
        ("llm_extraction", "provider", ""), ("llm_extraction", "dotenv_path", "/no/such"), ("llm_extraction", "what", 1), ("data_preprocessing", "target_column", ""), ("data_preprocessing", "drop_target_column", 1),
        ("data_preprocessing", "splitting", {"type": "X"}), ("semantic_cache", "backend", "x"), ("semantic_cache", "max_size_mb", 0), ("schema", "spec_path", "/no/such.yaml"),
    ],
)
def test_bad_configuration(section, key, value):
    base = {"spec": {"variables": []}} if section == "schema" and key != "spec_path" else {}
    with pytest.raises(ConfigError):
        Config.from_dict({section: base | {key: value}, **({} if section == "schema" else {"schema": {"spec": {}}})})


def test_contradictions():
    for bad in ({"llm_extraction": {"max_budget": 1, "track_cost": False}}, {"data_preprocessing": {"preprocessed_data_path": "x", "drop_target_column": True}}):
        with pytest.raises(ConfigError):
            Config.from_dict(bad | {"schema": {"spec": {}}})
