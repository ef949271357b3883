"""Queries on sources and sinks: whole tables written in each format and read back, and what a run keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError, StoreError
from ..functions.markup import html_to_text
from ..functions.text import RegexSplit
from ..operators import chunks as C
from ..operators import extraction
from ..pipeline import Pipeline
from ..sources import readers, writers
from ..sources.store import MemoryStore, Store, shared_folder
from .registry import LINES, query, table

_DOCS = "SELECT doc_id, lang, source, n_chars, sha256(text) AS sha FROM documents"
_ITEMS = "SELECT 'item_' || item_id || '{suffix}' AS file_name, text AS raw_text, row_number() OVER (ORDER BY 'item_' || item_id || '{suffix}') - 1 AS record_id FROM benchmark"


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha"))


# tables


@query(_DOCS)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV, texts with line ends and quotes, and read as a folder."""
    path = shared_folder(spark, "csv") + "/documents"
    writers.write_csv(table(spark, sf_dir, "documents").repartition(4), path)
    return _documents(readers.load(spark, path, "text"))


@query(_DOCS)
def source_parquet_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "parquet") + "/documents"
    table(spark, sf_dir, "documents").repartition(4).write.parquet(path)
    return _documents(readers.load(spark, path, "text"))


@query(_DOCS)
def source_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "feather") + "/documents"
    writers.write_tables(table(spark, sf_dir, "documents").repartition(4), path, ".feather", writers.feather_bytes)
    return _documents(readers.load(spark, path, "text"))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks; the types of columns are found again."""
    path = shared_folder(spark, "xlsx") + "/customers"
    writers.write_tables(table(spark, sf_dir, "customer").repartition(3), path, ".xlsx", writers.xlsx_bytes)
    return readers.load(spark, path, "c_name").drop("record_id")


@query("SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CASE WHEN doc_id % 2 = 1 THEN length(text) END AS size FROM documents")
def source_csv_of_two_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of different columns in one folder: what a file lacks is null."""
    path, docs = shared_folder(spark, "csv") + "/both", table(spark, sf_dir, "documents")
    even = docs.where("doc_id % 2 = 0").select("doc_id", "lang", "n_chars", "source")
    odd = docs.where("doc_id % 2 = 1").select("doc_id", "lang", "n_chars", F.length("text").alias("size"))
    writers.write_csv(even, path + "/even")
    writers.write_csv(odd, path + "/odd")
    rows = readers.load(spark, path, "lang")
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("doc_id", "n_chars", "size")], "lang", "source")


# texts


def _texts(spark: SparkSession, sf_dir: str, suffix: str, convert=str.encode) -> DataFrame:  # noqa: ANN001
    """Items of the benchmark as files, in two folders below one."""
    path, items = shared_folder(spark, "texts") + "/items", table(spark, sf_dir, "benchmark").repartition(4)
    below = F.concat(F.when(F.col("item_id") % 2 == 0, F.lit("even/")).otherwise(F.lit("odd/")), F.lit("item_"), F.col("item_id"), F.lit(suffix))
    writers.write_files(items, path, below, F.col("text"), convert)
    return readers.load(spark, path)


@query(_ITEMS.format(suffix=".txt"))
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, ".txt")


@query(_ITEMS.format(suffix=".md"))
def source_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, ".md")


@query(_ITEMS.format(suffix=".docx"))
def source_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, ".docx", writers.docx_bytes)


@query(_ITEMS.format(suffix=".html"))
def source_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes of small pages."""
    return _texts(spark, sf_dir, ".html", lambda t: f"<html><head><title></title></head><body><p>{t}</p></body></html>".encode())


@query(_ITEMS.format(suffix=".pdf"))
def source_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a kind that needs a converter: one that is registered for it."""
    before = readers.LOADERS[".pdf"]
    readers.register_converter(".pdf", lambda raw: html_to_text(raw.decode()))
    try:
        return _texts(spark, sf_dir, ".pdf", lambda t: f"<p>{t}</p>".encode())
    finally:
        readers.LOADERS[".pdf"] = before


@query("SELECT item_id, text FROM benchmark")
def source_own_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "own") + "/items"
    table(spark, sf_dir, "benchmark").repartition(2).write.json(path)
    before = dict(readers.LOADERS)
    readers.register(".json", lambda s, p, folder: s.read.option("recursiveFileLookup", True).json(p), needs_target=True)
    try:
        return readers.load(spark, path, "text").select("item_id", "text")
    finally:
        readers.LOADERS.clear()
        readers.LOADERS.update(before)


@query("SELECT * FROM (VALUES ('.bin', 'no reader'), ('mixed', 'several kinds'), ('nowhere', 'missing'), ('no target', 'no column'), ('.csv', 'needs a target'), ('.txt', 'needs none')) t(what, said)")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be loaded is an error that says why."""
    path, items = shared_folder(spark, "mixed"), table(spark, sf_dir, "benchmark")
    name = lambda ext: F.concat(F.lit("i"), F.col("item_id"), ext)
    writers.write_files(items, path + "/a", name(F.when(F.col("item_id") % 2 == 0, F.lit(".txt")).otherwise(F.lit(".md"))), F.col("text"))
    writers.write_files(items, path + "/b", name(F.lit(".bin")), F.col("text"))

    def said(words: dict[str, str], source: object, target: str | None = None) -> str:
        try:
            readers.load(spark, source, target)
        except SourceError as e:
            return next((v for k, v in words.items() if k in str(e)), str(e))
        return "loaded"

    rows = [
        (".bin", said({"no reader": "no reader"}, path + "/b")),
        ("mixed", said({"several kinds": "several kinds"}, path + "/a")),
        ("nowhere", said({"doesn't exist": "missing"}, path + "/c")),
        ("no target", said({"no column": "no column"}, items, "body")),
        *((x, "needs a target" if readers.needs_target(x) else "needs none") for x in (".csv", ".txt")),
    ]
    return spark.createDataFrame(rows, "what string, said string")


@query("SELECT count(*) AS records, CAST(0 AS BIGINT) AS least, count(*) - 1 AS greatest, count(*) AS ids FROM documents")
def source_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids are dense."""
    rows = readers.load(spark, table(spark, sf_dir, "documents").repartition(5), "text")
    i = "record_id"
    return rows.agg(F.count("*").alias("records"), F.min(i).alias("least"), F.max(i).alias("greatest"), F.count_distinct(i).alias("ids"))


# what a run keeps


def _store(spark: SparkSession) -> Store:
    store = Store(spark, shared_folder(spark, "run") + "/run")
    store.initialise({"a": 1}, {"v": []})
    return store


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(table(spark, sf_dir, "documents"), "text", RegexSplit("\n"), drop_target=True, drop_empty=True, record_id="doc_id")


@query(f"WITH {LINES} SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, doc_id, chunk FROM c")
def store_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    store.save_chunks(_lines(spark, sf_dir))
    return store.load_chunks().select("chunk_id", "doc_id", "chunk")


_BATCHES = "SELECT doc_id, {text} AS text, doc_id // 500 AS batch_id FROM documents"


@query(f"WITH b AS ({_BATCHES.format(text='CASE WHEN doc_id // 500 = 1 THEN upper(lang) ELSE lang END')}) SELECT * FROM b WHERE batch_id <> 2")
def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are written, one is written again, one is deleted, and what is left is one table."""
    store = _store(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("text"), F.floor(F.col("doc_id") / 500).cast("bigint").alias("batch_id"))
    store.save_batches(rows)
    store.save_batches(rows.where("batch_id = 1").withColumn("text", F.upper("text")))
    store.delete_batch(2)
    return store.batches().select("doc_id", "text", "batch_id")


@query("SELECT DISTINCT doc_id // 500 AS batch_id FROM documents")
def store_batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    store.save_batches(table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 500).cast("bigint").alias("batch_id")))
    return spark.createDataFrame([(i,) for i in store.batch_ids()], "batch_id bigint")


@query(f"{_BATCHES.format(text='lang')} ")
def store_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a folder."""
    store = MemoryStore(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("text"), F.floor(F.col("doc_id") / 500).cast("bigint").alias("batch_id"))
    store.save_batches(rows.where("batch_id < 1"))
    store.save_batches(rows.where("batch_id >= 1"))
    return store.save_results(store.batches()).select("doc_id", "text", "batch_id")


@query("SELECT 'state' AS what, CAST(count(*) AS VARCHAR) AS value FROM documents UNION ALL SELECT * FROM (VALUES ('changed', 'config.a'), ('exists', 'error'), ('both', 'error'), ('completed', 'error'), ('cleaned', '0')) t")
def store_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is resumed with the configuration it was made with, as long as it isn't completed; its state stays when its batches go."""
    store, docs = _store(spark), table(spark, sf_dir, "documents")

    def refused(**how: object) -> str:
        try:
            Store(spark, store.path).initialise(**how)
        except StoreError as e:
            return ",".join(e.detail["changed"]) if "changed" in e.detail else "error"
        return "done"

    same = {"config": {"a": 1}, "spec": {"v": []}}
    rows = [("changed", refused(config={"a": 2}, spec={"v": []}, resume=True)), ("exists", refused(**same)), ("both", refused(**same, overwrite=True, resume=True))]
    store.save_state({"records": docs.count()})
    store.save_batches(docs.select("doc_id", F.lit(0).cast("bigint").alias("batch_id")))
    store.save_results(store.batches())
    store.cleanup()
    rows += [("completed", refused(**same, resume=True)), ("cleaned", str(len(store.batch_ids()))), ("state", str(store.state()["records"]))]
    return spark.createDataFrame(rows, "what string, value string")


# the whole way

_CONFIG = {
    "llm_extraction": {"provider": "openai", "name": "gpt-4o-mini", "batch_size": 10, "max_workers": 4, "max_retries": 1, "base_delay": 0.0},
    "data_preprocessing": {"target_column": "text", "splitting": {"type": "none"}},
    "schema": {"spec": {"variables": [{"name": "first", "required": True}, {"name": "size", "data_type": "integer"}]}, "prompt_template": "{text}"},
}


def _answer(prompt: str) -> dict:
    """Stands for a service: the first word of a prompt and its length; it refuses what begins with an accent."""
    if ord(prompt[0]) > 127:
        raise ValueError("not this one")
    return {"first": prompt.split(" ")[0], "size": len(prompt)}


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("record_id"), "text")


def _run(spark: SparkSession, sf_dir: str, store: Store | None = None, answer=_answer, budget: float | None = None, resume: bool = False) -> Pipeline:  # noqa: ANN001
    config = {k: dict(v) for k, v in _CONFIG.items()}
    config["data_preprocessing"].pop("splitting")
    config["llm_extraction"]["max_budget"] = budget
    return Pipeline(spark, config, answer, store, resume=resume)


_ANSWERED = """
    SELECT conv_id * 100 + turn AS record_id, CASE WHEN ascii(text) <= 127 THEN string_split(text, ' ')[1] END AS first, CASE WHEN ascii(text) <= 127 THEN length(text) END AS size,
        CASE WHEN ascii(text) > 127 THEN '["ValueError: not this one"]' END AS errors FROM conversations
"""


def _answered(rows: DataFrame) -> DataFrame:
    return rows.select("record_id", "extracted.first", "extracted.size", "errors")


@query(_ANSWERED)
def extract_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is asked in tasks, with threads and retries; what fails is an error of its row."""
    run = _run(spark, sf_dir)
    run.prep_data(_turns(spark, sf_dir))
    return _answered(run.process())


@query(_ANSWERED)
def resume_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that breaks off after its second wave is resumed: the waves that were saved aren't asked again (they would fail), and the result is whole."""
    store = Store(spark, shared_folder(spark, "resume") + "/run")
    first = _run(spark, sf_dir, store)
    first.prep_data(_turns(spark, sf_dir))
    saved, count = store.save_batches, [0]

    def breaks(rows: DataFrame) -> None:
        if count[0] == 2:
            raise InterruptedError("the driver is gone")
        count[0] += 1
        saved(rows)

    store.save_batches = breaks
    try:
        first.process(wave=1)
        raise AssertionError("it should have broken off")
    except InterruptedError:
        pass
    again = Store(spark, store.path)
    done = {r[0] for r in again.batches().select("chunk").collect()}  # of two batches

    def answer(prompt: str) -> dict:
        if prompt in done:
            raise RuntimeError("asked twice")
        return _answer(prompt)

    return _answered(_run(spark, sf_dir, again, answer, resume=True).process())


@query("""SELECT 2 AS batches, true AS stopped, true AS within""")
def budget_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With output far dearer than input, a budget that all input fits in many times ends the run after the batch that spends it."""
    config = {k: dict(v) for k, v in _CONFIG.items()}
    config["data_preprocessing"].pop("splitting")
    config["llm_extraction"] |= {"max_budget": 1.0, "model_input_cost_per_1M_tokens": 0.01, "model_output_cost_per_1M_tokens": 6000.0, "batch_size": 10}
    run = Pipeline(spark, config, lambda p: {"first": "abcd", "size": 10_000_000})
    run.prep_data(_turns(spark, sf_dir))
    out = run.process()
    total = run.cost_summary().select("total_cost")
    told = out.agg(F.count_distinct("batch_id").cast("int").alias("batches"))
    return told.crossJoin(total).select("batches", (F.col("total_cost") > 1.0).alias("stopped"), (F.col("total_cost") < 1.7).alias("within"))


@query(f"""
    WITH {LINES}, n AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, chunk FROM c)
    SELECT chunk_id, regexp_extract(chunk, '([A-Za-z]+)', 1) AS word FROM n WHERE regexp_matches(chunk, '[A-Za-z]')
""")
def preprocessed_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that another run made, read from their path."""
    path = shared_folder(spark, "preprocessed") + "/chunks.parquet"
    _lines(spark, sf_dir).withColumnRenamed("doc_id", "record_id").select("record_id", "chunk_id", "chunk").write.parquet(path)
    config = {**_CONFIG, "data_preprocessing": {"preprocessed_data_path": path}, "schema": {"spec": {"variables": [{"name": "word"}]}, "prompt_template": "{text}"}}
    run = Pipeline(spark, config, extraction.Rules({"word": "([A-Za-z]+)"}))
    run.prep_data(path)
    return run.process().where("extracted.word is not null").select("chunk_id", "extracted.word")


