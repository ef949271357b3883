"""Queries on relational tables, with what Spark itself brings: unions, set operations, windows, grouping sets, outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table


@query("SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that one side lacks are null."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").unionByName(pages, allowMissingColumns=True)


@query("""
    (SELECT c_custkey AS key, 'both' AS side FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders)
    UNION ALL (SELECT c_custkey, 'customer' FROM customer EXCEPT SELECT o_custkey, 'customer' FROM orders)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return customers.intersect(buyers).withColumn("side", F.lit("both")).union(customers.subtract(buyers).withColumn("side", F.lit("customer")))


@query("""
    SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS level
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def grouping_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.sum("l_quantity").cast("bigint").alias("quantity"), F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""
    SELECT o_custkey, o_orderkey, row_number() OVER w AS rank, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS step
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
""")
def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"), F.round(price - F.lag(price).over(w), 2).alias("step")
    )


@query("""
    SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers
    FROM nation FULL JOIN customer ON c_nationkey = n_nationkey FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name
""")
def outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is counted before it is joined, so that nothing is multiplied."""
    count = lambda name, by, n: table(spark, sf_dir, name).groupBy(F.col(by).alias("k")).agg(F.count("*").alias(n))
    nations = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    both = nations.join(count("customer", "c_nationkey", "customers"), "k", "full").join(count("supplier", "s_nationkey", "suppliers"), "k", "full")
    return both.groupBy("n_name").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "suppliers")])


@query("""
    SELECT 'union' AS what, key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY key
    UNION ALL SELECT 'intersect', key, count(*) FROM (SELECT c_nationkey AS key FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) GROUP BY key
    UNION ALL SELECT 'except', key, count(*) FROM (SELECT c_nationkey AS key FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY key
""")
def set_operations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With repetitions."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    counted = lambda df, what: df.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "key", "n")
    return counted(a.unionAll(b), "union").union(counted(a.intersectAll(b), "intersect")).union(counted(a.exceptAll(b), "except"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def grouping_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT event_type, true AS near_distinct, true AS near_median, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches are within 5 % of the exact values (2 % of ranks for the median)."""
    events = table(spark, sf_dir, "events")
    out = events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("a"), F.percentile_approx("value", 0.5, 1000).alias("m"),
        F.percentile("value", 0.48).alias("lo"), F.percentile("value", 0.52).alias("hi"),
    )
    return out.select("event_type", (F.abs(F.col("a") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("near_distinct"), F.col("m").between(F.col("lo"), F.col("hi")).alias("near_median"), "users")


@query("""
    SELECT l.event_id, r.event_id AS last_error FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error') r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last error of its user up to then, without a join: both sides go through one window over the user's events."""
    events = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") != "error")).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("last_error", F.last(error, ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "last_error")


@query("""
    SELECT n_name, count(*) AS richer FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > c_acctbal GROUP BY n_name
""")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a nation's customers and richer suppliers, counted without being made: each balance has a row, and a running count of the suppliers above it."""
    side = lambda name, p, c, s: table(spark, sf_dir, name).select(F.col(f"{p}_nationkey").alias("k"), F.col(f"{p}_acctbal").alias("balance"), F.lit(c).alias("c"), F.lit(s).alias("s"))
    both = side("customer", "c", 1, 0).union(side("supplier", "s", 0, 1)).where("balance IS NOT NULL")
    counts = both.groupBy("k", "balance").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    above = F.sum("s").over(Window.partitionBy("k").orderBy(F.desc("balance")).rowsBetween(Window.unboundedPreceding, -1))
    pairs = counts.withColumn("above", above).groupBy("k").agg(F.sum(F.col("c") * F.col("above")).alias("richer")).where("richer > 0")
    nations = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    return pairs.join(nations, "k").select("n_name", "richer")
