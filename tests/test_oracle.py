"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from loomwork import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows: list[tuple]) -> list[tuple]:
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    cur = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = plans.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.select(*names).collect()]) == plain(want)


def test_queries_without_sql_are_known():
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == {"exact_token_counts", "fuzzy_scores", "html_texts", "coverage_curve"}


@pytest.mark.parametrize("name", ["exact_token_counts", "fuzzy_scores", "html_texts"])
def test_queries_without_sql_run_over_whole_tables(spark, name):
    source = {"exact_token_counts": "documents", "fuzzy_scores": "conversations", "html_texts": "pages"}[name]
    assert plans.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
