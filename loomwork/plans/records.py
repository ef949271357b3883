"""Queries on answers and records: extraction, reading, cleaning, exploding, merging, evaluation, the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import cache, evaluation, extraction, results
from ..sources.store import Store, shared_folder
from ..spec import MultipleSpec, NestedSpec, SimpleSpec, Variable
from .registry import LINES, query, table
from .texts import lines

K = "CAST(props->>'$.k' AS BIGINT)"
EVENT = SimpleSpec((Variable("k", data_type="integer", required=True),))


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


# extraction

MAIL = "[a-zA-Z0-9.]+@[a-zA-Z0-9.]+"
FOUND = SimpleSpec((Variable("number", data_type="integer"), Variable("word"), Variable("mails", data_type="[string]")))


@query(rf"""
    SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\d+)', 1), '') AS BIGINT) AS number, nullif(regexp_extract(text, '([A-Z][a-z]+)', 1), '') AS word,
        CAST(to_json(regexp_extract_all(text, '({MAIL})', 1)) AS VARCHAR) AS mails FROM documents
""")
def rule_extract_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = extraction.Rules({"number": r"(\d+)", "word": "([A-Z][a-z]+)", "mails": f"({MAIL})"})
    out = table(spark, sf_dir, "documents").select("doc_id", rules.column(F.col("text"), FOUND).alias("x"))
    return out.select("doc_id", "x.number", "x.word", F.to_json("x.mails").alias("mails"))


ADDRESSES = NestedSpec((Variable("user", required=True), Variable("host")), "addresses")


@query(f"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{MAIL}')) AS m FROM documents)
    SELECT doc_id, string_split(m, '@')[1] AS user, string_split(m, '@')[2] AS host FROM m
""")
def rule_extract_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as nested items, cleaned and exploded."""
    rules = extraction.Rules({"user": "^([^@]+)@", "host": "@(.+)$"}, item=MAIL)
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", A.clean(rules.column(F.col("text"), ADDRESSES), ADDRESSES, F.col("text")).alias("extracted"))
    return results.explode(found, ADDRESSES)


# reading answers


@query(f"SELECT event_id, {K} AS k FROM events")
def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", A.read(F.col("props"), EVENT)["k"].alias("k"))


LAX = SimpleSpec((Variable("n", data_type="number"), Variable("b", data_type="boolean"), Variable("i", data_type="integer")))


@query(f"""
    SELECT event_id, CASE WHEN k % 3 < 2 AND k % 4 < 3 THEN CAST(k AS DOUBLE) END AS n, CASE WHEN k % 3 < 2 AND k % 4 < 3 THEN k % 3 = 1 END AS b,
        CASE WHEN k % 3 < 2 AND k % 4 < 3 THEN k END AS i, CASE WHEN k % 3 = 2 OR k % 4 = 3 THEN 'doesn''t fit the spec' END AS problem
    FROM (SELECT event_id, {K} AS k FROM events)
""")
def lax_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of strings, booleans out of 0 and 1, whole numbers out of 5.0; one value that can't be coerced rejects the answer."""
    k = F.col("k")
    made = F.concat(F.lit('{"n": "'), k, F.lit('", "b": '), k % 3, F.lit(', "i": '), k, F.when(k % 4 == 3, F.lit(".5")).otherwise(F.lit(".0")), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", _k().alias("k")).select("event_id", made.alias("answer"))
    return rows.select("event_id", A.read_or_error(F.col("answer"), LAX).alias("r")).select("event_id", "r.value.n", "r.value.b", "r.value.i", F.col("r.error").alias("problem"))


@query(f"""
    SELECT event_id, CASE WHEN event_id % 4 = 1 THEN '["root.k: not a integer but STRING"]' WHEN event_id % 4 = 2 THEN '["root.label: missing"]' WHEN event_id % 4 = 3 THEN '["root.k: missing","root.label: missing"]' ELSE '[]' END AS problems FROM events
""")
def validate_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected answers that are right, of a wrong type, without a field and without any."""
    spec = SimpleSpec((Variable("k", data_type="integer", required=True), Variable("label", required=True)))
    i = F.col("event_id")
    label = F.concat(F.lit(', "label": "'), "event_type", F.lit('"}'))
    whole = F.concat(F.lit('{"k": '), _k(), label)
    wrong = F.concat(F.lit('{"k": "'), "event_type", F.lit('"'), label)
    made = F.when(i % 4 == 0, whole).when(i % 4 == 1, wrong).when(i % 4 == 2, F.concat(F.lit('{"k": '), _k(), F.lit("}"))).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(A.problems(made, spec)).alias("problems"))


# cleaning

NOTED = SimpleSpec((Variable("kind", required=True), Variable("tags", data_type="[string]", allowed_values=("click", "error")), Variable("mention", validate_in_text=True)))


@query("""
    WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'Unknown' WHEN event_id % 5 = 0 THEN 'N/A' ELSE event_type END AS kind FROM events)
    SELECT event_id, kind, CASE WHEN event_type IN ('click', 'error') THEN '["' || event_type || '"]' ELSE '[]' END AS tags, CASE WHEN event_id % 2 = 0 THEN event_type END AS mention
    FROM e WHERE lower(kind) NOT IN ('none', 'null', 'unknown', 'n/a', '')
""")
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null words, allowed values, values that have to be in the text, required ones."""
    i, kind = F.col("event_id"), F.col("event_type")
    answer = F.struct(
        F.when(i % 7 == 0, F.lit("Unknown")).when(i % 5 == 0, F.lit("N/A")).otherwise(kind).alias("kind"),
        F.array(kind, F.lit("none"), F.upper(kind)).alias("tags"),
        F.when(i % 2 == 0, kind).otherwise(F.lit("absent")).alias("mention"),
    )
    text = F.concat(F.lit("One "), F.upper(kind), F.lit(" by a user"))
    cleaned = table(spark, sf_dir, "events").select("event_id", A.clean(answer, NOTED, text).alias("extracted"))
    return results.explode(cleaned, NOTED).withColumn("tags", F.to_json("tags"))


ITEMS = NestedSpec((Variable("name", required=True), Variable("k", data_type="integer")), "items")


@query(f"SELECT event_id, event_type AS name, {K} AS k FROM events WHERE event_id % 3 > 0")
def clean_and_explode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two items the one without a name goes; an answer without items makes no row."""
    item = lambda name: F.struct(name.alias("name"), _k().alias("k"))
    first = F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(F.lit("n/a"))
    answer = F.struct(F.array(item(first), item(F.lit("NONE"))).alias("items"))
    rows = table(spark, sf_dir, "events").select("event_id", A.clean(answer, ITEMS, F.lit("")).alias("extracted"))
    return results.explode(rows, ITEMS)


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{}' ELSE '{"kind":"' || event_type || '","tags":[],"mention":null}' END AS json FROM events""")
def answers_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are written out; what failed is {}."""
    kind = F.when(F.col("event_id") % 7 > 0, F.col("event_type"))
    answer = F.struct(kind.alias("kind"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("mention"))
    return table(spark, sf_dir, "events").select("event_id", A.to_json(A.clean(answer, NOTED, F.lit(""))).alias("json"))


PARTS = MultipleSpec((("event", SimpleSpec((Variable("kind", required=True),))), ("amounts", NestedSpec((Variable("value", data_type="number", required=True),), "list"))))


@query("""
    SELECT event_id, event_type AS event_kind, CAST(NULL AS DOUBLE) AS amounts_value, 'event' AS schema_name FROM events
    UNION ALL SELECT event_id, NULL, value, 'amounts' FROM events
    UNION ALL SELECT event_id, NULL, -value, 'amounts' FROM events
""")
def explode_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c: F.struct(c.alias("value"))
    answer = F.struct(
        F.struct(F.col("event_type").alias("kind")).alias("event"),
        F.struct(F.array(value(F.col("value")), value(-F.col("value")), value(F.lit(None).cast("double"))).alias("list")).alias("amounts"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", A.clean(answer, PARTS, F.lit("")).alias("extracted"))
    return results.explode(rows, PARTS)


# merging


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
    SELECT user_id, event_type AS top FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.majority(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), "event_id", "top")


TURN = SimpleSpec((Variable("role"), Variable("words", data_type="[string]")))


@query("""
    WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL),
    r AS (SELECT conv_id, role FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1)
    SELECT conv_id, any_value(r.role) AS role, CAST(to_json(flatten(list([string_split(text, ' ')[1], string_split(text, ' ')[-1]] ORDER BY turn))) AS VARCHAR) AS words
    FROM conversations JOIN r USING (conv_id) GROUP BY conv_id
""")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a record's chunks made one: scalars by majority, lists one after another."""
    parts = F.split("text", " ", -1)
    answer = F.struct(F.col("role"), F.array(F.get(parts, F.lit(0)), F.element_at(parts, -1)).alias("words"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("extracted"))
    return results.merge(rows, TURN, by="conv_id", order="turn").select("conv_id", "extracted.role", F.to_json("extracted.words").alias("words"))


SAID = NestedSpec((Variable("who"), Variable("size", data_type="integer")), "said")


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS said FROM conversations GROUP BY conv_id")
def merge_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.struct(F.array(F.struct(F.col("role").alias("who"), F.length("text").cast("bigint").alias("size"))).alias("said"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("extracted"))
    merged = results.merge(rows, SAID, by="conv_id", order="turn")
    return merged.select("conv_id", F.array_join(F.transform("extracted.said", lambda x: F.concat(x["who"], F.lit(":"), x["size"])), " ").alias("said"))


# joins


@query("SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l LEFT JOIN documents d USING (doc_id)")
def metadata_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the columns of their chunks; what has no result stays out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return results.with_metadata(labels, table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


# evaluation

JUDGED = SimpleSpec((Variable("quality", data_type="integer", required=True), Variable("toxic", data_type="integer")))
_PREDICTED = "SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS quality, CASE WHEN lang <> 'fr' THEN CASE WHEN contains(lower(text), 'ea') THEN 1 ELSE 0 END END AS toxic FROM documents"


@query(f"""
    WITH p AS ({_PREDICTED}),
    j AS (SELECT 'quality' AS field, l.quality AS t, p.quality AS p FROM labels l JOIN p USING (doc_id) UNION ALL SELECT 'toxic', l.toxic, p.toxic FROM labels l JOIN p USING (doc_id)),
    c AS (SELECT field, count(*) FILTER (p = t) AS tp, count(*) FILTER (p IS NOT NULL AND p <> t) AS fp, count(*) FILTER (p IS NULL OR p <> t) AS fn FROM j GROUP BY field)
    SELECT field, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c
""")
def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a rule against the labels."""
    n, one, zero = F.col("n_chars"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    toxic = F.when(F.col("lang") != "fr", F.when(F.lower("text").contains("ea"), one).otherwise(zero))
    found = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.when(n > 300, one).otherwise(zero).alias("quality"), toxic.alias("toxic")).alias("extracted"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.struct(F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic")).alias("expected"))
    out = evaluation.evaluate(found, truth, JUDGED, "doc_id")
    return out.select("field", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
    WITH {LINES}, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, pos) AS chunk_id, chunk FROM c)
    SELECT count(DISTINCT doc_id) AS records, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (contains(chunk, '@')) AS chunks_with_errors FROM n
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an at sign stand for failed ones."""
    rows = lines(spark, sf_dir).withColumn("chunk_id", F.struct("doc_id", "pos")).withColumnRenamed("doc_id", "record_id")
    return extraction.run_summary(rows.withColumn("errors", F.when(F.col("chunk").contains("@"), F.lit('["x"]'))))


# the cache


@query("""
    WITH d AS (SELECT doc_id, sha256(text) AS key, text, lang FROM documents), h AS (SELECT DISTINCT key FROM d WHERE lang = 'en')
    SELECT doc_id, substr(text, 1, 5) AS answer, key IN (SELECT key FROM h) AS hit FROM d
""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of English texts are cached; of the others each distinct text is asked once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.col("text").alias("prompt"), "lang")
    answer = F.substring("prompt", 1, 5)
    known = docs.where("lang = 'en'").groupBy("key").agg(F.first(answer).alias("value"))
    ask = lambda df: df.select("key", answer.alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))
    answered, _ = extraction.answers(docs, ask, known, Store(spark, shared_folder(spark, "cached-answers")).keep)
    return answered.select("doc_id", "answer", "hit")


_CACHE = "SELECT sha256(text) AS key, max(doc_id) AS seen, max(strlen(text)) AS bytes FROM documents GROUP BY 1"


def _cache_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.sha2("text", 256).alias("key"), F.col("text").alias("value"), F.timestamp_seconds(F.col("doc_id") * 60).alias("ts"), F.octet_length("text").cast("bigint").alias("bytes"))


@query(f"SELECT count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_CACHE})")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(_cache_table(spark, sf_dir))


@query(f"""
    WITH c AS ({_CACHE}), r AS (SELECT key, bytes, sum(bytes) OVER (ORDER BY seen DESC, key ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT key, bytes FROM r WHERE run <= 1000000
""")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries within a megabyte."""
    return cache.prune(_cache_table(spark, sf_dir), 1_000_000).select("key", "bytes")


_HITS = "SELECT lang = 'en' AS hit, sha256(text) AS key, text FROM documents"


@query(f"WITH d AS ({_HITS}), h AS (SELECT DISTINCT key FROM d WHERE hit) SELECT count(DISTINCT key) AS entries, CAST((SELECT sum(b) FROM (SELECT DISTINCT key, strlen(text) AS b FROM d)) AS BIGINT) AS bytes, count(*) FILTER (key IN (SELECT key FROM h)) AS hits, count(*) FILTER (key NOT IN (SELECT key FROM h)) AS misses FROM d")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of English texts are in the cache; hits and misses of asking all, and what is there afterwards."""
    folder = shared_folder(spark, "cache-hits")
    kept = cache.AnswerCache(spark, folder + "/cache", 10_000)
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), F.col("text").alias("prompt"), "lang")
    kept.add(docs.where("lang = 'en'").groupBy("key").agg(F.first("prompt").alias("value")))
    ask = lambda df: df.select("key", F.col("prompt").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))
    answered, fresh = extraction.answers(docs, ask, kept.read(), Store(spark, folder).keep)
    kept.count(answered)
    kept.add(fresh)
    kept.compact()
    return kept.stats()


BOTH = MultipleSpec((("turn", SimpleSpec((Variable("role"),))), ("said", NestedSpec((Variable("size", data_type="integer"),), "list"))))


@query("""
    WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL),
    r AS (SELECT conv_id, role FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1)
    SELECT conv_id, any_value(r.role) AS role, string_agg(length(text)::VARCHAR, ' ' ORDER BY turn) AS sizes FROM conversations JOIN r USING (conv_id) GROUP BY conv_id
""")
def merge_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.array(F.struct(F.length("text").cast("bigint").alias("size"))).alias("list"))
    answer = F.struct(F.struct("role").alias("turn"), item.alias("said"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("extracted"))
    merged = results.merge(rows, BOTH, by="conv_id", order="turn")
    return merged.select("conv_id", "extracted.turn.role", F.array_join(F.transform("extracted.said.list", lambda x: x["size"].cast("string")), " ").alias("sizes"))


@query("""SELECT event_id, '{"a":' || user_id || ',"b":{"c":["' || event_type || '"],"d":null}}' AS json FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order at every depth."""
    inner = F.struct(F.lit(None).cast("string").alias("d"), F.array("event_type").alias("c"))
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(inner.alias("b"), F.col("user_id").alias("a")).alias("x"))
    return rows.select("event_id", results.canonical_json(F.col("x"), rows.schema["x"].dataType).alias("json"))
