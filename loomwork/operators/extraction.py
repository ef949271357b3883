"""Getting answers for prompts: by rules, natively, or by a callable per prompt.

The callable stands for any remote service. It runs in tasks, with threads,
retries and an error column instead of failures; equal prompts are asked once;
answers that a cache table has are not asked again. What it returns is
written before it is used twice, so nothing is asked again by recomputation.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..spec import NestedSpec, SimpleSpec, Spec


def _caster(kind: T.DataType) -> Callable[[Column], Column]:
    return lambda x: x.try_cast(kind)


@dataclass(frozen=True)
class Rules:
    """Answers from patterns, in native expressions: name -> pattern, whose first group is the value. List variables take all matches, others the first; `integer` and `number` are cast, null where that fails.

    Of a nested spec each match of `item` is an item, in which the patterns are looked for.
    """

    patterns: Mapping[str, str]
    item: str | None = None

    def column(self, text: Column, spec: Spec) -> Column:
        if isinstance(spec, SimpleSpec):
            return self._struct(text, spec.variables)
        if isinstance(spec, NestedSpec) and self.item:
            return F.struct(F.transform(F.regexp_extract_all(text, F.lit(self.item), F.lit(0)), lambda t: self._struct(t, spec.variables)).alias(spec.container))
        raise ConfigError("rules answer simple specs, and nested ones with an item pattern")

    def _struct(self, text: Column, variables: tuple) -> Column:
        fields = []
        for v in variables:
            p = self.patterns.get(v.name)
            if p is None:
                c = F.lit(None).cast(v.spark_type)
            elif v.is_list:
                c = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _caster(v.spark_type.elementType))
            else:
                c = F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast(v.spark_type)
            fields.append(c.alias(v.name))
        return F.struct(*fields)


def cache_key(prompt: Column, system: str, model: str, temperature: float) -> Column:
    """SHA-256, in hex, of the canonical JSON of a call."""
    call = F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(system).alias("system"), F.lit(float(temperature)).alias("temperature"))
    return F.sha2(F.to_json(call), 256)


def with_retry(call: Callable[[str], object], prompt: str, retries: int, delay: float, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """(answer, attempts); waits delay * 2^n between attempts, and raises the last error, which then knows its attempts."""
    for n in range(retries + 1):
        try:
            return call(prompt), n + 1
        except Exception as e:  # noqa: BLE001
            if n == retries:
                e.attempts = n + 1
                raise
            sleep(delay * 2**n)
    raise AssertionError


@dataclass(frozen=True)
class Caller:
    """How prompts are asked."""

    call: Callable[[str], object]
    threads: int = 1
    retries: int = 3
    delay: float = 1.0

    def ask(self, prompts: DataFrame) -> DataFrame:
        """(key, answer, error, attempts) for (key, prompt); never fails for an error of the call."""
        call, threads, retries, delay = self.call, self.threads, self.retries, self.delay

        def one(p: str | None) -> tuple[str | None, str | None, int]:
            if p is None:
                return None, "no prompt", 0
            try:
                got, n = with_retry(call, p, retries, delay)
                return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False), None, n
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}", getattr(e, "attempts", 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(max(1, threads)) as pool:
                for batch in batches:
                    got = list(pool.map(one, batch.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), *(pa.array([g[i] for g in got], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int32())))],
                        names=["key", "answer", "error", "attempts"],
                    )

        return prompts.select("key", "prompt").mapInArrow(run, "key string, answer string, error string, attempts int")


def answers(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], cache: DataFrame | None, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(prompts with answer, error, attempts and hit; the new cache rows).

    prompts has key and prompt. Keys that the cache (key, value) has are hits;
    the others are asked once each. keep() writes a table and reads it back.
    """
    wanted = prompts.select("key", "prompt").groupBy("key").agg(F.first("prompt").alias("prompt"))
    if cache is not None:
        wanted = wanted.join(cache.select("key"), "key", "left_anti")
    asked = keep(ask(wanted))
    fresh = asked.where("error is null").select("key", F.col("answer").alias("value"))
    known = asked.select("key", "answer", "error", "attempts", F.lit(False).alias("hit"))
    if cache is not None:
        hits = cache.select("key", F.col("value").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(True).alias("hit"))
        known = known.unionByName(hits)
    return prompts.join(known, "key", "left"), fresh


def result_table(df: DataFrame) -> DataFrame:
    """The columns of a result, with errors as a JSON list, null where there is none."""
    return df.withColumn("errors", F.when(F.col("error").isNotNull(), F.to_json(F.array("error")))).drop("error")


def run_summary(results: DataFrame) -> DataFrame:
    """One row: records, chunks, and chunks with errors."""
    return results.agg(
        F.count_distinct("record_id").alias("records"),
        F.count_distinct("chunk_id").alias("chunks"),
        F.count_if(F.col("errors").isNotNull()).alias("chunks_with_errors"),
    )
