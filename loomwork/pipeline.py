"""The whole way, from a source to typed records: prepare, ask, clean, keep."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import ConfigError, StoreError
from .functions.tokens import approx_tokens
from .operators import answers as A
from .operators import chunks as C
from .operators import costs, evaluation, extraction, results
from .operators.cache import AnswerCache
from .operators.names import unused
from .operators.prompts import prompt
from .sources.readers import load, with_record_ids
from .sources.store import MemoryStore, Store
from .spec import Spec


WAVE, FOLDERS = 1000, 1000
PART, OVER = "_part", "Over budget"


class Pipeline:
    """A run of a configuration.

    `answer` is a callable prompt -> JSON text or object, asked in tasks with
    threads and retries, or Rules, which answer natively. `count` is the
    Column function that counts tokens.
    """

    def __init__(
        self,
        spark: SparkSession,
        config: Config | Mapping[str, Any] | str | Path,
        answer: Callable[[str], object] | extraction.Rules,
        store: Store | None = None,
        overwrite: bool = False,
        resume: bool = False,
        count: Callable[[Column], Column] = approx_tokens,
    ):
        self.spark, self.config, self.answer, self.count = spark, Config.from_any(config), answer, count
        self.store = store or MemoryStore(spark)
        self.spec: Spec = self.config.schema.load()
        model = self.config.llm_extraction
        if model.dotenv_path:
            _load_env(model.dotenv_path)
        self.prices = costs.price(model.provider, model.name, (model.model_input_cost_per_1M_tokens, model.model_output_cost_per_1M_tokens)) if model.track_cost else (0.0, 0.0)
        cache = self.config.semantic_cache
        self.cache = None if cache is None else AnswerCache(spark, cache.path, cache.max_size_mb)
        self.store.initialise(self.config.to_dict(), self.config.schema.spec_dict(), overwrite=overwrite, resume=resume)

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str | Path, answer: Callable[[str], object] | extraction.Rules, **how: Any) -> Pipeline:
        return cls(spark, Config.from_file(path), answer, **how)

    @classmethod
    def from_dict(cls, spark: SparkSession, d: Mapping[str, Any], answer: Callable[[str], object] | extraction.Rules, **how: Any) -> Pipeline:
        return cls(spark, Config.from_dict(d), answer, **how)

    def prep_data(self, source: DataFrame | str, sample_size: int = -1) -> DataFrame:
        """Chunks of the source, kept in the store; of a sample of its records, if 0 < sample_size < their number."""
        p = self.config.data_preprocessing
        if p.preprocessed_data_path:
            chunks = self._preprocessed(load(self.spark, p.preprocessed_data_path, "chunk"))
        else:
            records = C.sample(load(self.spark, source, p.target_column), sample_size, "record_id")
            chunks = C.prepare(records, p.target_column, p.splitter, p.scorer, p.pandas_score_filter, drop_target=p.drop_target_column)
        return self.store.save_chunks(chunks)

    @staticmethod
    def _preprocessed(chunks: DataFrame) -> DataFrame:
        if "chunk_id" not in chunks.columns:
            raise ConfigError("preprocessed data has chunk and chunk_id", columns=chunks.columns)
        return chunks if "record_id" in chunks.columns else with_record_ids(chunks)

    def process(self, path: str | None = None, wave: int = WAVE) -> DataFrame:
        """Results for the chunks of the store (or of a table): extracted, extracted_json, errors, tokens, and the chunks' other columns.

        Batches are asked in waves of `wave`, each of which is saved before the
        next begins, so a run that breaks off loses a wave at most; equal
        prompts are asked once a wave, and with a cache once; a resumed run
        asks no prompt that it has saved an answer for. A budget is held
        against what was spent, on input, output and repeated attempts: no
        wave begins beyond it, waves begin with one batch and are then of as
        many as half of what is left pays for, and calls that their input
        alone puts beyond it are refused.
        """
        model = self.config.llm_extraction
        chunks = self._preprocessed(load(self.spark, path, "chunk")) if path else self.store.load_chunks()
        calls = self.store.keep(self._calls(chunks))
        current, todo, done = calls.select("chunk_id", "key"), calls, None
        if self.store.has_batches():  # what has been answered is known by its content, not by its place
            done = self.store.keep(self.store.batches().join(current, ["chunk_id", "key"], "left_semi"))
            todo = self.store.keep(calls.join(done.select("chunk_id", "key"), ["chunk_id", "key"], "left_anti"))
            again = self._again(todo, done)
            if not again.isEmpty():
                done = self.store.keep(done.unionByName(again))
                self.store.save_batches(done)
                todo = self.store.keep(todo.join(again.select("chunk_id", "key"), ["chunk_id", "key"], "left_anti"))
        first, end = todo.agg(F.min("batch_id"), F.max("batch_id")).first()
        at = first
        if isinstance(self.answer, extraction.Rules) and model.max_budget is None:
            wave = 1 << 62  # nothing is paid for
        run, span = todo, None
        if at is not None and end - at >= wave:  # so that a wave reads what is its own, and not all there is
            span = max(wave, (end - first) // FOLDERS + 1)
            folder = F.floor((F.col("batch_id") - first) / span).cast("int")
            run = self.store.keep(todo.withColumn(PART, folder), by=PART)
            done = None if done is None else self.store.keep(done.withColumn(PART, folder), by=PART)

        def of(rows: DataFrame, lo: int, hi: int) -> DataFrame:
            found = rows.where(F.col("batch_id").between(lo, hi))
            return found if span is None else found.where(F.col(PART).between((lo - first) // span, (hi - first) // span)).drop(PART)

        spent, tried, size = 0.0 if done is None else self._cost(done), 0, wave if model.max_budget is None else 1
        before = spent
        while at is not None and at <= end and (model.max_budget is None or spent <= model.max_budget):
            hi = min(end, at + size - 1)
            part = of(run, at, hi)
            fresh = self._batch(self._answered(part.where("not over")))
            if model.max_budget is not None:
                fresh = fresh.unionByName(self._batch(self._refused(part)))
            if done is not None:  # a batch is replaced as a whole, so its earlier rows come along
                fresh = fresh.unionByName(of(done, at, hi).join(part.select("batch_id").distinct(), "batch_id", "left_semi").select(fresh.columns))
            self.store.save_batches(fresh)
            at, tried = at + size, tried + size
            if model.max_budget is not None:
                spent = before + self._cost(self._of(todo))
                each = (spent - before) / tried
                size = max(1, min(wave, int((model.max_budget - spent) / 2 / each))) if each > 0 else wave
        try:
            rows = self.store.batches().join(current, ["chunk_id", "key"], "left_semi")
        except StoreError:  # nothing to ask
            rows = self._batch(self._refused(calls.limit(0)))
        table = results.with_metadata(rows.drop("key"), chunks.drop("chunk", "batch_id"))
        out = self.store.save_results(table)
        if model.track_cost:
            self.store.save_state(self.cost_summary(out).first().asDict())
        self.store.cleanup()
        return out

    def _calls(self, chunks: DataFrame) -> DataFrame:
        """chunks with prompt, key, tokens and whether their input alone is over budget."""
        model, schema = self.config.llm_extraction, self.config.schema
        calls = C.batches(chunks, model.batch_size).withColumn("prompt", prompt(F.col("chunk"), self.spec, schema.prompt_template))
        calls = calls.withColumn("key", extraction.cache_key(F.col("prompt"), schema.system_prompt, model.model, model.temperature))
        calls = calls.withColumn("call_tokens", self.count(F.concat(F.lit(schema.system_prompt + "\n"), "prompt")))
        if model.max_budget is None:
            return calls.withColumn("over", F.lit(False))
        (price,) = unused([*calls.columns, "over"], "_cost")
        priced = calls.drop("batch_id").withColumn(price, F.coalesce("call_tokens", F.lit(0)) * F.lit(self.prices[0] / 1e6))
        return costs.budget_gate(priced, price, model.max_budget, model.batch_size).drop(price)

    @staticmethod
    def _again(todo: DataFrame, done: DataFrame) -> DataFrame:
        """Rows of batches for what is to do of which an equal call has been answered, or has failed, at no cost."""
        same = ["key", "chunk"]
        asked = done.where(F.col("errors").isNull() | (F.col("errors") != F.to_json(F.array(F.lit(OVER)))))
        kept = [c for c in ("extracted", "extracted_json", "errors") if c in done.columns]
        known = asked.groupBy(same).agg(F.first(F.struct(*kept)).alias("_known"))
        rows = todo.join(known, same).select("chunk_id", "batch_id", *same, *[F.col("_known")[c].alias(c) for c in kept])
        none = F.lit(0).cast("bigint")
        return rows.withColumns({"tokens_in": none, "tokens_out": none}).select(done.columns)

    def _of(self, todo: DataFrame) -> DataFrame:
        """Rows of the store's batches that answer what was to do."""
        return self.store.batches().join(todo.select("chunk_id", "key"), ["chunk_id", "key"], "left_semi")

    def _cost(self, rows: DataFrame) -> float:
        return rows.agg(F.coalesce(F.sum(costs.cost(F.col("tokens_in"), F.col("tokens_out"), self.prices)), F.lit(0.0))).first()[0]

    def _answered(self, todo: DataFrame) -> DataFrame:
        if isinstance(self.answer, extraction.Rules):
            got = A.to_json(self.answer.column(F.col("chunk"), self.spec))
            return todo.withColumn("answer", F.when(F.col("chunk").isNotNull(), got)).withColumn("error", F.when(F.col("chunk").isNull(), F.lit("no prompt"))).withColumn("attempts", F.lit(1)).withColumn("hit", F.lit(False))
        model = self.config.llm_extraction
        ask = extraction.Caller(self.answer, model.max_workers, model.max_retries, model.base_delay).ask
        cached = None if self.cache is None else self.store.keep(self.cache.read())
        out, fresh = extraction.answers(todo, ask, cached, self.store.keep)
        if self.cache is not None:
            self.cache.count(out)
            self.cache.add(fresh)
            self.cache.compact()
        return out

    @staticmethod
    def _refused(calls: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return calls.where("over").withColumn("answer", none).withColumn("error", F.lit(OVER)).withColumn("attempts", F.lit(0)).withColumn("hit", F.lit(False))

    def _batch(self, answered: DataFrame) -> DataFrame:
        """Columns of a batch: the answer read and cleaned, as a struct and as JSON; errors as a JSON list."""
        text = F.col("chunk")
        (got,) = unused(answered.columns, "_read")
        read = answered.withColumn(got, A.read_or_error(F.col("answer"), self.spec))
        error = F.coalesce("error", F.when(F.col("answer").isNotNull(), F.col(got)["error"]))
        rows = read.withColumn("error", error).withColumn("extracted", A.clean(F.col(got)["value"], self.spec, text)).drop(got)
        tracked = F.lit(self.config.llm_extraction.track_cost)
        tokens_in = F.when(tracked & ~F.col("hit"), F.col("call_tokens") * F.col("attempts")).otherwise(0)
        tokens_out = F.when(tracked & ~F.col("hit"), self.count(F.col("answer"))).otherwise(0)
        return results_columns(rows.withColumn("tokens_in", tokens_in.cast("bigint")).withColumn("tokens_out", F.coalesce(tokens_out, F.lit(0)).cast("bigint")))

    def results(self) -> DataFrame:
        return self.store.results()

    def cost_summary(self, table: DataFrame | None = None) -> DataFrame:
        """One row of tokens, prices and cost."""
        model = self.config.llm_extraction
        if not model.track_cost:
            raise ConfigError("costs aren't tracked")
        return costs.summary(self.results() if table is None else table, model.provider, model.name, self.prices)

    def run_summary(self) -> DataFrame:
        return extraction.run_summary(self.results())


def results_columns(rows: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull()
    made = extraction.result_table(rows.withColumn("extracted_json", F.when(~failed, A.to_json(F.col("extracted")))))
    return made.select("chunk_id", "batch_id", "chunk", "extracted", "extracted_json", "errors", "tokens_in", "tokens_out", "key")


def estimate_performance(
    spark: SparkSession,
    config: Config | Mapping[str, Any] | str | Path,
    answer: Callable[[str], object] | extraction.Rules,
    source: DataFrame,
    expected: DataFrame,
    key: str,
    expected_json: str = "expected_json",
    sample_size: int = -1,
    strict: bool = True,
) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) of a configuration against expected answers as JSON. Only records that have an expected answer are processed; a sample of those, if asked."""
    run = Pipeline(spark, config, answer)
    wanted = C.sample(expected.where(F.col(key).isNotNull()), sample_size, key)
    run.prep_data(source.join(wanted.select(key).distinct(), key, "left_semi"))
    merged = results.merge(run.process(), run.spec, by=key)
    truth = wanted.select(key, _unwrapped(A.read(F.col(expected_json), run.spec), run.spec).alias("expected"))
    return evaluation.evaluate(merged, truth, run.spec, key, strict)


def _unwrapped(answer: Column, spec: Spec) -> Column:
    """An expected answer in the shape that cleaning gives: containers inside `multiple` taken off."""
    return answer if spec.spark_type == spec.cleaned_type else A.unwrap(answer, spec)


def estimate_total_cost(
    spark: SparkSession, config: Config | Mapping[str, Any] | str | Path, answer: Callable[[str], object] | extraction.Rules, source: DataFrame, sample_size: int
) -> DataFrame:
    """One row: what the whole source would cost, from a sample that is run."""
    run = Pipeline(spark, config, answer)
    records = load(spark, source, run.config.data_preprocessing.target_column)

    def spent(picked: DataFrame) -> DataFrame:
        run.prep_data(picked)
        return run.process()

    return costs.estimate_total_cost(records, "record_id", sample_size, spent, run.prices)


def _load_env(path: str) -> None:
    """Lines NAME=value of a file, into the driver's environment; what is set stays."""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, found, value = line.strip().removeprefix("export ").partition("=")
        if found and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("'\""))
