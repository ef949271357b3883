"""Queries on texts: splitting, numbering, scoring, sampling, prompts, tokens and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions
from ..functions.markup import html_text
from ..functions.score import FuzzyScorer, KeywordScorer
from ..functions.text import FixedWindowSplit, ParagraphSplit, RegexSplit
from ..functions.tokens import approx_tokens, exact_tokens
from ..operators import chunks as C
from ..operators import costs, keywords
from ..operators.extraction import cache_key
from ..operators.prompts import SYSTEM, TEMPLATE, prompt
from ..spec import MultipleSpec, SimpleSpec, Variable, variables_text
from .registry import KEYWORDS, LINES, STRIPPED, any_keyword, literal, query, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SPEC = SimpleSpec((Variable("place", "where it happens", required=True), Variable("kind", "what it is", allowed_values=("a", "b")), Variable("years", "years it names", "[integer]")))


def lines(spark: SparkSession, sf_dir: str, ids: bool = False) -> DataFrame:
    return C.chunk(table(spark, sf_dir, "documents"), "text", RegexSplit("\n"), drop_target=True, drop_empty=True, record_id="doc_id", ids=ids)


# splitting


@query(f"WITH {LINES} SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM c WHERE {any_keyword('chunk')} GROUP BY lang")
def keyword_lines_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language, the lines that mention a keyword, and the documents they are of."""
    hits = conditions.query(C.score(lines(spark, sf_dir), KeywordScorer(KEYWORDS)), "score > 0.5")
    return hits.groupBy("lang").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {LINES} SELECT doc_id, pos, chunk FROM c")
def regex_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "chunk")


@query(rf"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\r?\n\s*\r?\n'), {STRIPPED}), lambda x: x <> '') AS pieces FROM documents)
    SELECT doc_id, unnest(range(len(pieces))) AS pos, unnest(pieces) AS chunk FROM l
""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends are doubled first, since these documents have no blank lines."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    out = C.chunk(docs, "text", ParagraphSplit(), drop_target=True, drop_empty=True, record_id="doc_id", ids=False)
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "chunk")


def _windows_sql(window: int, stride: int) -> str:
    return rf"""
        WITH s AS (
            SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), {STRIPPED}), lambda x: x <> '') AS s FROM documents
        ), w AS (SELECT doc_id, list_transform(range(0, len(s), {stride}), lambda i: array_to_string(list_slice(s, i + 1, i + {window}), ' ')) AS w FROM s)
        SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS chunk FROM w
    """


def _windows(spark: SparkSession, sf_dir: str, window: int, stride: int) -> DataFrame:
    out = C.chunk(table(spark, sf_dir, "documents"), "text", FixedWindowSplit(window, stride), drop_target=True, drop_empty=True, record_id="doc_id", ids=False)
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "chunk")


@query(_windows_sql(5, 5))
def sentence_windows_5_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 5, 5)


@query(_windows_sql(5, 2))
def sentence_windows_5_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows."""
    return _windows(spark, sf_dir, 5, 2)


@query(_windows_sql(2, 4))
def sentence_windows_2_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with gaps between them."""
    return _windows(spark, sf_dir, 2, 4)


@query(f"SELECT doc_id, text AS chunk, {any_keyword('text')} AS hit FROM documents")
def whole_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No splitter: the text itself is the chunk."""
    out = C.chunk(table(spark, sf_dir, "documents"), "text", None, record_id="doc_id", ids=False)
    return C.score(out, KeywordScorer(KEYWORDS)).select("doc_id", "chunk", (F.col("score") == 1).alias("hit"))


# ids, filters, samples


@query(f"WITH {LINES} SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, doc_id, pos FROM c")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, ids=True).select("chunk_id", "doc_id", F.col("pos").cast("bigint").alias("pos"))


@query(f"""
    WITH {LINES}, n AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, chunk FROM c),
    k AS (SELECT chunk_id FROM n WHERE {any_keyword('chunk')})
    SELECT chunk_id, (row_number() OVER (ORDER BY chunk_id) - 1) // 10 AS batch_id FROM k
""")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten of the chunks that a score filter leaves; chunk ids keep their gaps."""
    kept = C.prepare(table(spark, sf_dir, "documents"), "text", RegexSplit("\n"), KeywordScorer(KEYWORDS), "score == 1", drop_target=True, drop_empty=True, record_id="doc_id")
    return C.batches(kept.select("chunk_id"), 10)


@query(f"SELECT conv_id, turn, {any_keyword('text', ('the', 'une '))} AS hit FROM conversations WHERE {any_keyword('text', ('the', 'une '))} AND turn < 3 AND role IN ('user', 'system')")
def score_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query string over score and other columns."""
    scored = C.score(table(spark, sf_dir, "conversations").withColumnRenamed("text", "chunk"), KeywordScorer(("The", "une ")))
    kept = conditions.query(scored, "0.5 < score <= 1 and turn < 3 and role in ['user', 'system']")
    return kept.select("conv_id", "turn", (F.col("score") == 1).alias("hit"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE (n_chars % 7 = 3 OR lang <> 'en') AND NOT (source = 'src1') AND n_chars / 2 >= 100")
def query_string_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.query(table(spark, sf_dir, "documents"), "(n_chars % 7 == 3 | lang != 'en') & ~(source == 'src1') & n_chars / 2 >= 100").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(concat(doc_id, '42')), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


@query("SELECT doc_id, CAST('0x' || substr(md5(concat(doc_id, '42')), 1, 4) AS INTEGER) < CAST(0.2 * 65536 AS INTEGER) AS test FROM documents")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = C.split_train_test(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("test", F.lit(False)).union(test.withColumn("test", F.lit(True)))


@query("""
    SELECT conv_id, CAST(to_json(list_sort(list(DISTINCT role))) AS VARCHAR) AS roles, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS only_role
    FROM conversations GROUP BY conv_id
""")
def collapse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.collapse(table(spark, sf_dir, "conversations"), "conv_id", "role")
    return out.select("conv_id", F.to_json("role").alias("roles"), F.col("role_only").alias("only_role"))


# prompts, tokens, costs

_FRONT, _BACK = (literal(p) for p in TEMPLATE.replace("{variables}", variables_text(SPEC)).split("{text}"))
_TOKENS = "CAST(ceil(length(text) / 4.0) AS BIGINT)"


@query(f"SELECT doc_id, sha256({_FRONT} || text || {_BACK}) AS prompt_sha FROM documents")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(prompt(F.col("text"), SPEC), 256).alias("prompt_sha"))


WHO = SimpleSpec((Variable("name", "who it is"),))
_SECOND, _REST = (literal(p) for p in TEMPLATE.replace("{variables}", variables_text(WHO)).split("{text}"))


@query(f"SELECT conv_id, turn, sha256('## PLACE' || chr(10) || {_FRONT} || text || {_BACK} || chr(10) || chr(10) || '## WHO' || chr(10) || {_SECOND} || text || {_REST}) AS prompt_sha FROM conversations")
def prompt_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several specs in one prompt, each under its name."""
    both = MultipleSpec((("place", SPEC), ("who", WHO)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(prompt(F.col("text"), both), 256).alias("prompt_sha"))


@query(f"""
    SELECT doc_id, sha256('{{"model":"openai/gpt-4o-mini","prompt":' || CAST(to_json(text) AS VARCHAR) || ',"system":' || CAST(to_json({literal(SYSTEM)}) AS VARCHAR) || ',"temperature":0.0}}') AS key FROM documents
""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cache_key(F.col("text"), SYSTEM, "openai/gpt-4o-mini", 0.0).alias("key"))


_PRICES = ", ".join(f"({literal(p)}, {literal(m)}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for p, m, a, b in costs.PRICES)


@query(f"""
    WITH p(provider, model, input, output) AS (VALUES {_PRICES}),
    d AS (SELECT lang, sum({_TOKENS}) AS tokens, CASE lang WHEN 'en' THEN 'openai' WHEN 'fr' THEN 'anthropic' ELSE 'nobody' END AS provider,
        CASE lang WHEN 'en' THEN 'gpt-4o-mini' WHEN 'fr' THEN 'claude-3-5-haiku-latest' ELSE 'none' END AS model FROM documents GROUP BY lang)
    SELECT lang, CAST(tokens AS BIGINT) AS tokens, round(tokens * (input / 1e6) + tokens * (output / 1e6), 6) AS cost FROM d LEFT JOIN p USING (provider, model)
""")
def token_cost_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are looked up whatever the case; a model without a price costs null."""
    lang = F.col("lang")
    calls = (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(F.sum(approx_tokens(F.col("text"))).alias("tokens"))
        .withColumn("provider", F.when(lang == "en", F.lit("OpenAI")).when(lang == "fr", F.lit("Anthropic")).otherwise(F.lit("nobody")))
        .withColumn("model", F.when(lang == "en", F.lit("GPT-4o-mini")).when(lang == "fr", F.lit("Claude-3-5-Haiku-latest")).otherwise(F.lit("none")))
    )
    priced = costs.with_prices(calls, costs.prices(spark))
    return priced.select("lang", "tokens", F.round(F.col("tokens") * (F.col("input") / 1e6) + F.col("tokens") * (F.col("output") / 1e6), 6).alias("cost"))


@query(f"""
    WITH c AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
    r AS (SELECT *, coalesce(sum(tokens) OVER w, 0) AS spent, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM c
        WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT batch_id FROM r GROUP BY batch_id HAVING min(spent) <= 50000)
    SELECT doc_id, tokens, batch_id, spent > 50000 AS over FROM r WHERE batch_id IN (SELECT batch_id FROM s)
""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 50,000 tokens, in batches of 16."""
    calls = table(spark, sf_dir, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens"))
    return costs.budget_gate(calls, "tokens", 50_000, 16, order="doc_id").select("doc_id", "tokens", "batch_id", "over")


@query(f"""
    SELECT count(*) AS calls, CAST(sum(CAST(ceil(length({literal(SYSTEM)} || chr(10) || {_FRONT} || text || {_BACK}) / 4.0) AS BIGINT)) AS BIGINT) AS input_tokens,
        CAST(round(sum(CAST(ceil(length({literal(SYSTEM)} || chr(10) || {_FRONT} || text || {_BACK}) / 4.0) AS BIGINT)) * 0.0000006, 6) AS DOUBLE) AS cost FROM documents
""")
def estimate_input_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").withColumnRenamed("text", "chunk")
    return costs.estimate_input_cost(chunks, SPEC, costs.price("openai", "gpt-4o-mini")).withColumn("cost", F.round("cost", 6))


@query(f"""
    WITH s AS (SELECT {_TOKENS} AS t FROM documents ORDER BY md5(concat(doc_id, '42')), doc_id LIMIT 150), n AS (SELECT count(*) AS n FROM documents)
    SELECT max(n) AS records, least(max(n), 150) AS sampled, CAST(round(sum(t * 0.0000006 + 10 * 0.0000024), 6) AS DOUBLE) AS spent,
        CAST(round(sum(t * 0.0000006 + 10 * 0.0000024) * max(n) / least(max(n), 150), 4) AS DOUBLE) AS estimate FROM s, n
""")
def estimate_total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled from a sample of 150 documents; every answer is taken to have ten tokens."""
    run = lambda df: df.select(approx_tokens(F.col("text")).alias("tokens_in"), F.lit(10).alias("tokens_out"))
    out = costs.estimate_total_cost(table(spark, sf_dir, "documents"), "doc_id", 150, run, costs.price("openai", "gpt-4o-mini"))
    return out.select("records", F.col("sampled").cast("bigint").alias("sampled"), F.round("spent", 6).alias("spent"), F.round("estimate", 4).alias("estimate"))


@query(f"""
    SELECT 'openai' AS provider, 'gpt-4o' AS model, CAST(sum({_TOKENS}) AS BIGINT) AS input_tokens, CAST(sum(length(lang)) AS BIGINT) AS output_tokens,
        CAST(5 AS DOUBLE) AS input_price, CAST(20 AS DOUBLE) AS output_price, CAST(round(sum({_TOKENS}) * 0.000005 + sum(length(lang)) * 0.00002, 6) AS DOUBLE) AS total_cost FROM documents
""")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "documents").select(approx_tokens(F.col("text")).alias("tokens_in"), F.length("lang").alias("tokens_out"))
    return costs.summary(calls, "openai", "gpt-4o", costs.price("openai", "gpt-4o")).withColumn("total_cost", F.round("total_cost", 6))


@query()
def exact_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by a tokenizer file: no SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", exact_tokens(F.col("text"), TOKENIZER).alias("tokens"))


# fuzzy scores, HTML


@query()
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best partial ratio with a keyword: no SQL."""
    scorer = FuzzyScorer(("therefore", "question"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(scorer.column(F.col("text")), 6).alias("score"))


@query()
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes of pages: no SQL."""
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


# keyword discovery

_STOP = ", ".join(literal(w) for w in keywords.STOP_WORDS)


@query(rf"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL),
    kept AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 2000),
    n AS (SELECT count(*) AS n FROM documents),
    w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN kept USING (term), n),
    u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
    y AS (SELECT count(*) AS n, sum(toxic) AS n1 FROM labels),
    s AS (SELECT term, sum(weight) AS s, sum(weight * toxic) AS s1 FROM u JOIN labels USING (doc_id) GROUP BY term),
    x AS (SELECT term, s1, s - s1 AS s0, s * n1 / n AS e1, s - s * n1 / n AS e0, s1 / n1 AS m1, (s - s1) / (n - n1) AS m0 FROM s, y),
    b AS (SELECT term, round(coalesce((s1 - e1) * (s1 - e1) / nullif(e1, 0), 0) + coalesce((s0 - e0) * (s0 - e0) / nullif(e0, 0), 0), 6) AS chi2, m1, m0 FROM x ORDER BY 2 DESC, term LIMIT 500)
    SELECT row_number() OVER (ORDER BY chi2 DESC, term) AS rank, term, chi2 FROM b WHERE round(m1, 9) > round(m0, 9) ORDER BY chi2 DESC, term LIMIT 100
""")
def keyword_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred terms that tell toxic documents best."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    out = keywords.discover(table(spark, sf_dir, "documents"), labels, "doc_id", "text")
    return out.select(F.col("rank").cast("bigint").alias("rank"), "term", "chi2")


SWEEP = ("license", "token", "über", "est ", "the ", "und")


@query(f"""
    WITH {LINES}, r AS (SELECT CASE {' '.join(f"WHEN contains(lower(chunk), {literal(k)}) THEN {i + 1}" for i, k in enumerate(SWEEP))} END AS rank,
        CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS r, CAST(ceil(length(chunk) / 4.0) AS BIGINT) AS t FROM c),
    a AS (SELECT sum(r) AS r, sum(t) AS t FROM r), k AS (SELECT unnest(range(0, {len(SWEEP) + 1})) AS k)
    SELECT CAST(k AS INTEGER) AS keywords, count(rank) AS selected, round(coalesce(sum(r.r), 0) / max(a.r), 6) AS coverage, round((max(a.t) - coalesce(sum(r.t), 0)) / max(a.t), 6) AS saving
    FROM k LEFT JOIN r ON r.rank <= k, a GROUP BY k
""")
def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of English lines the first n keywords find, and what share of tokens they spare."""
    out = keywords.coverage(lines(spark, sf_dir), list(SWEEP), F.col("lang") == "en", approx_tokens(F.col("chunk")))
    return out.select("keywords", "selected", F.round("coverage", 6).alias("coverage"), F.round("saving", 6).alias("saving"))


@query()
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage against cost for 0 to 100 keywords that the train part gives, on both parts: no SQL, since the keywords are found first."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return keywords.sweep(table(spark, sf_dir, "documents"), labels, "doc_id", "text", approx_tokens(F.col("text")))
