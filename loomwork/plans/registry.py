"""The registry of queries, and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(text: str) -> str:
    """Text as a literal of SQL."""
    return "'" + text.replace("'", "''") + "'"


KEYWORDS = ("license", "token", "tion the", "über")
STRIPPED = r"lambda x: trim(x, E' \t\n\r')"
LINES = rf"""
    l AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), {STRIPPED}), lambda x: x <> '') AS pieces FROM documents),
    c AS (SELECT doc_id, lang, source, unnest(pieces) AS chunk, unnest(range(len(pieces))) AS pos FROM l)
"""


def any_keyword(column: str, words: tuple[str, ...] = KEYWORDS) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {literal(w)})" for w in words) + ")"
