"""Token costs, budgets and estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.tokens import approx_tokens
from ..spec import Spec
from .chunks import blocks, sample
from .names import unused
from .prompts import SYSTEM, TEMPLATE, prompt

# US dollars for a million tokens: provider, model, input, output
PRICES = [
    tuple(f(x) for f, x in zip((str, str, float, float), line.split(), strict=True))
    for line in """
openai gpt-4.1 2 8
openai gpt-4.1-mini 0.4 1.6
openai gpt-4.1-nano 0.1 0.4
openai o3 2 8
openai o4-mini 1.1 4.4
openai gpt-4o 5 20
openai gpt-4o-mini 0.6 2.4
anthropic claude-opus-4-20250514 15 75
anthropic claude-sonnet-4-20250514 3 15
anthropic claude-3-7-sonnet-20250219 3 15
anthropic claude-3-5-sonnet-20241022 3 15
anthropic claude-3-5-haiku-20241022 0.8 4
anthropic claude-3-opus-20240229 15 75
anthropic claude-3-haiku-20240307 0.25 1.25
anthropic claude-opus-4-0 15 75
anthropic claude-sonnet-4-0 3 15
anthropic claude-3-7-sonnet-latest 3 15
anthropic claude-3-5-sonnet-latest 3 15
anthropic claude-3-5-haiku-latest 0.8 4
""".strip().splitlines()
]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, model string, input double, output double")


def price(provider: str, model: str, overrides: tuple[float | None, float | None] = (None, None)) -> tuple[float, float]:
    """(input, output) for a million tokens; overrides win, and an unknown model without both of them is an error."""
    if None not in overrides:
        return overrides
    for p, m, a, b in PRICES:
        if (p, m) == (provider.lower(), model.lower()):
            return (a if overrides[0] is None else overrides[0], b if overrides[1] is None else overrides[1])
    raise ConfigError(f"no price is known for {provider}/{model}", provider=provider, model=model)


def with_prices(calls: DataFrame, table: DataFrame) -> DataFrame:
    """calls (provider, model, ...) with their prices, whatever the case; null for unknown models."""
    keyed = table.select(F.lower("provider").alias("_p"), F.lower("model").alias("_m"), "input", "output")
    return calls.join(keyed, (F.lower("provider") == F.col("_p")) & (F.lower("model") == F.col("_m")), "left").drop("_p", "_m")


def cost(tokens_in: Column, tokens_out: Column, per_million: tuple[float, float]) -> Column:
    return tokens_in * F.lit(per_million[0] / 1e6) + tokens_out * F.lit(per_million[1] / 1e6)


def call_tokens(chunk: Column, spec: Spec, template: str = TEMPLATE, system: str = SYSTEM, attempts: Column | int = 1, count: Callable[[Column], Column] = approx_tokens) -> Column:
    """Input tokens of a call: system message, a line end, prompt; once for each attempt."""
    return count(F.concat(F.lit(system + "\n"), prompt(chunk, spec, template))) * attempts


def budget_gate(calls: DataFrame, cost_column: str, budget: float | None, batch_size: int, order: str = "chunk_id", block: int | None = None) -> DataFrame:
    """calls that are made or refused, when they are made one after another: `over` says that the cost of all before exceeds the budget.

    Once a batch starts over budget, it and all after it aren't there; in the
    batch in which the budget is exceeded, the calls after that are there, and
    over. The running sum is two-level: within blocks of `order`, plus the sum
    of the blocks before.
    """
    if budget is None:
        return calls.withColumn("over", F.lit(False))
    own, n, s0, n0, row, before, start = unused([*calls.columns, "batch_id", "over"], "_block", "_n", "_s0", "_n0", "_row", "_before", "_start")
    blocked = blocks(calls, own, order, block)
    sums = blocked.groupBy(own).agg(F.sum(cost_column).alias(s0), F.count("*").alias(n))
    earlier = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(own, F.coalesce(F.sum(s0).over(earlier), F.lit(0)).alias(s0), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n0))
    inside = Window.partitionBy(own).orderBy(order)
    rows = (
        blocked.join(offsets, own)
        .withColumn(row, F.col(n0) + F.row_number().over(inside) - 1)
        .withColumn(before, F.col(s0) + F.coalesce(F.sum(cost_column).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("batch_id", F.floor(F.col(row) / batch_size).cast("bigint"))
    )
    # costs aren't negative, so what is spent before a batch is the least of its rows
    starts = rows.groupBy("batch_id").agg(F.min(before).alias(start)).where(F.col(start) <= budget)
    kept = rows.join(starts.select("batch_id"), "batch_id", "left_semi")
    return kept.withColumn("over", F.col(before) > budget).drop(own, s0, n0, row, before)


def spent_before(batches: DataFrame, tokens_in: str, tokens_out: str, per_million: tuple[float, float]) -> DataFrame:
    """(batch_id, cost, spent): what each batch of calls cost, in and out, and what all batches before it cost together. One row a batch."""
    each = batches.groupBy("batch_id").agg(F.sum(cost(F.col(tokens_in), F.col(tokens_out), per_million)).alias("cost"))
    earlier = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("spent", F.coalesce(F.sum("cost").over(earlier), F.lit(0.0)))


def summary(calls: DataFrame, provider: str, model: str, per_million: tuple[float, float], tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """One row: tokens, prices and cost of all calls."""
    total = calls.agg(F.coalesce(F.sum(tokens_in), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(tokens_out), F.lit(0)).alias("output_tokens"))
    return total.select(
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        "input_tokens",
        "output_tokens",
        F.lit(per_million[0]).alias("input_price"),
        F.lit(per_million[1]).alias("output_price"),
        cost(F.col("input_tokens"), F.col("output_tokens"), per_million).alias("total_cost"),
    )


def estimate_input_cost(chunks: DataFrame, spec: Spec, per_million: tuple[float, float], template: str = TEMPLATE, system: str = SYSTEM, count: Callable[[Column], Column] = approx_tokens) -> DataFrame:
    """One row: calls, input tokens and their cost, before any call is made."""
    tokens = call_tokens(F.col("chunk"), spec, template, system, count=count)
    return chunks.agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("input_tokens")).withColumn("cost", F.col("input_tokens") * F.lit(per_million[0] / 1e6))


def estimate_total_cost(records: DataFrame, key: str, n: int, run: Callable[[DataFrame], DataFrame], per_million: tuple[float, float]) -> DataFrame:
    """One row: the cost of all records, scaled from n sampled ones; run(records) gives tokens_in and tokens_out of its calls. A sample of more rows than there are is all of them."""
    total = records.agg(F.count("*").alias("records"))
    picked = sample(records, n, key)
    spent = run(picked).agg(F.coalesce(F.sum(cost(F.col("tokens_in"), F.col("tokens_out"), per_million)), F.lit(0.0)).alias("spent"))
    # the three sides have one row each
    sampled = total.select(F.least("records", F.lit(n if n > 0 else 1 << 62)).alias("sampled"), "records")
    return sampled.crossJoin(spent).select("records", "sampled", "spent", F.coalesce(F.try_divide(F.col("spent") * F.col("records"), "sampled"), F.lit(0.0)).alias("estimate"))
