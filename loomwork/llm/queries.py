"""The queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, lines, lm, minhash, packing, pii, quality, substrings, topk
from .store import Scratch, documents


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), Scratch(spark, "op1"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), Scratch(spark, "op3"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(documents(spark, sf_dir), Scratch(spark, "op4"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op5"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir), Scratch(spark, "op6"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_duplicate_lines(documents(spark, sf_dir), Scratch(spark, "op7"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(documents(spark, sf_dir), Scratch(spark, "op8"))


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row whose id is divisible by 20, against all rows."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op9"), every=20)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_quality_classifier,
        op3_lm_scoring,
        op4_packing,
        op5_fingerprints,
        op6_pii,
        op7_line_dedup,
        op8_substring_dedup,
        op9_top_k_search,
        op10_bpe,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op9_top_k_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        ), u AS (
            SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v
        ), s AS (
            SELECT a.vec_id, b.vec_id AS neighbour, round(list_inner_product(a.e, b.e), 6) AS score
            FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS rank FROM s
        )
        SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, score FROM r WHERE rank <= 10
    """,
}
