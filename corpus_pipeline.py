"""The corpus pipeline: documents in, packed training windows out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next one. All but the
last return the columns of documents, whatever they are besides doc_id and
text, and of whatever names.

For all stages: an empty table gives an empty one; rows that repeat a doc_id
are rows of their own; very long texts are taken whole; a null in a column
other than doc_id and text changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import lines, minhash, packing, pii, quality
from loomwork.llm.store import Scratch, documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go. A null, empty or blank text stays, since nothing says that it is bad, and so does one whose score is just the threshold; without labels of both classes nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines, the first by (doc_id, line) stays, a null doc_id before all others; a document that has none left goes. Null, empty and blank texts stay; rows that repeat a doc_id and a line fare alike."""
    return lines.drop_duplicate_lines(docs, Scratch(spark, "line-dedup"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents, that of the least doc_id stays, with all rows of that doc_id. Null doc_ids and texts, and texts without a word, stay."""
    return minhash.drop_near_duplicates(docs, Scratch(spark, "near-duplicates"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kind; n_chars is that of documents. Null and empty texts stay as they are; equal scores go to the least kind."""
    return pii.redact(docs, Scratch(spark, "pii"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows for training, in the order of doc_id, nulls first; null, empty and blank texts are in no window."""
    return packing.pack_tokens(docs, Scratch(spark, "packing"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("pii", pii_redaction),
    ("packing", pack),
]

# SQL can express neither the trained classifier nor MinHash grouping: the tests hold run() against plain Python, which takes only the classifier's decisions as they are
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else scratch.save(made)
    return docs
