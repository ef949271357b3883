"""Queries over the standard tables, one or more for each operator, with SQL that gives the same rows."""

from . import records, sources, streams, tables, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "records", "sources", "streams", "tables", "texts"]
