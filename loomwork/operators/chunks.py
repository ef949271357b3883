"""Records, chunks, batches: splitting, ids, scores, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, SourceError
from ..functions.conditions import query
from ..functions.score import Scorer
from ..functions.text import Splitter
from .names import unused

SEED, ID_BLOCK, MAX_BLOCKS = 42, 100_000, 1_000_000


def need_column(df: DataFrame, name: str | None) -> str:
    """The target column, or an error that says which there are."""
    if not name:
        raise SourceError("tables need a target column", columns=df.columns)
    if name not in df.columns:
        raise SourceError(f"no column {name!r}; there are {', '.join(df.columns)}", column=name, columns=df.columns)
    return name


def blocks(df: DataFrame, name: str, key: str, block: int | None, bounds: DataFrame | None = None) -> DataFrame:
    """df with a column `name` of block numbers, which ascend with the integer column `key` (nulls first).

    A block is a range of `block` values or, where none is given, of ID_BLOCK
    or more: of so many that there are at most MAX_BLOCKS, however far apart
    the keys are. bounds: rows whose `key` has the same least and greatest value.
    """
    null = F.lit(-(1 << 63))
    if block:
        return df.withColumn(name, F.coalesce(F.floor(F.col(key) / F.lit(block)).cast("bigint"), null))
    (width,) = unused(df.columns, "_width")
    k = F.col(key).cast("double")
    # one row
    wide = (df if bounds is None else bounds).agg(F.greatest(F.lit(float(ID_BLOCK)), (F.max(k) - F.min(k)) / MAX_BLOCKS).alias(width))
    return df.crossJoin(F.broadcast(wide)).withColumn(name, F.coalesce(F.floor(k / F.col(width)).cast("bigint"), null)).drop(width)


def dense_ids(df: DataFrame, name: str, key: str, *then: str, block: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """df with a column of numbers 0, 1, 2 ... in the order of (key, *then); key is an integer.

    Two levels, so that no task sees all rows: rows are numbered within blocks
    of key values, and a block's offset is the running count of the blocks
    before it (one row a block). It needs one shuffle of the rows.
    """
    _block, _offset, _at = unused([*df.columns, name], "_block", "_offset", "_at")
    blocked = blocks(df, _block, key, block, bounds)
    counts = blocked.groupBy(_block).agg(F.count("*").alias(_at))
    before = Window.orderBy(_block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(_block), F.coalesce(F.sum(_at).over(before), F.lit(0)).alias(_offset))
    inside = Window.partitionBy(_block).orderBy(F.col(key).asc_nulls_first(), *then)
    return (
        blocked.withColumn(_at, F.row_number().over(inside) - 1)
        .join(offsets, _block)
        .withColumn(name, (F.col(_offset) + F.col(_at)).cast("bigint"))
        .drop(_block, _offset, _at)
    )


def chunk(
    records: DataFrame,
    target: str,
    splitter: Splitter | None,
    drop_target: bool = False,
    drop_empty: bool = False,
    record_id: str = "record_id",
    ids: bool = True,
) -> DataFrame:
    """A row for each chunk, with chunk, pos (its place in the record) and chunk_id (dense over all chunks).

    Without a splitter the target column is the chunk, under that name. A
    record without a chunk keeps one row with a null chunk, unless drop_empty.
    """
    need_column(records, target)
    clash = [c for c in records.columns if c != target and c.lower() in ("chunk", "pos", *["chunk_id"] * ids)]
    if clash:
        raise ConfigError(f"records have columns of the names that chunks get: {', '.join(clash)}", columns=clash)
    if splitter is None:
        if drop_target:
            raise ConfigError("the target column can only be dropped when it is split", column=target)
        out = records.withColumnRenamed(target, "chunk").withColumn("pos", F.lit(0))
    else:
        pieces = splitter.column(F.col(target))
        explode = F.posexplode if drop_empty else F.posexplode_outer
        rest = [c for c in records.columns if not (drop_target and c == target)]
        out = records.select(*rest, explode(pieces).alias("pos", "chunk")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    return dense_ids(out, "chunk_id", record_id, "pos", bounds=records) if ids else out


def score(chunks: DataFrame, scorer: Scorer | None) -> DataFrame:
    """chunks with their score, where there is a scorer."""
    return chunks if scorer is None else chunks.withColumn("score", scorer.column(F.col("chunk")))


def prepare(
    records: DataFrame,
    target: str,
    splitter: Splitter | None = None,
    scorer: Scorer | None = None,
    score_filter: str | None = None,
    **how: object,
) -> DataFrame:
    """Split, number, score and filter. Ids are given before the filter, so they keep their gaps."""
    out = score(chunk(records, target, splitter, **how), scorer)
    return query(out, score_filter) if score_filter and scorer is not None else out


def batches(chunks: DataFrame, size: int, by: str = "chunk_id") -> DataFrame:
    """chunks with batch_id: runs of `size` rows in the order of `by`."""
    (row,) = unused([*chunks.columns, "batch_id"], "_row")
    return dense_ids(chunks, row, by).withColumn("batch_id", F.floor(F.col(row) / size).cast("bigint")).drop(row)


def sample_order(key: Column, seed: int = SEED) -> Column:
    """A fixed pseudo-random order, which any SQL engine can compute."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def sample(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """n rows, where 0 < n < number of rows; else all. A top-n over a hash: no full sort."""
    return df if n <= 0 else df.orderBy(sample_order(F.col(key), seed), key).limit(n)


def split_train_test(df: DataFrame, key: str, test: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) by buckets of a hash of the key; no shuffle."""
    bucket = F.conv(F.substring(sample_order(F.col(key), seed), 1, 4), 16, 10).cast("int")
    cut = F.lit(int(test * 65536))
    return df.where(bucket >= cut), df.where(bucket < cut)


def collapse(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """For each value of `by` that isn't null: the distinct values of each column in order, and, as <column>_only, the value if there is one alone."""
    sets = [F.array_sort(F.collect_set(c)).alias(c) for c in columns]
    out = df.where(F.col(by).isNotNull()).groupBy(by).agg(*sets)
    return out.select("*", *[F.when(F.size(c) == 1, F.element_at(c, 1)).alias(f"{c}_only") for c in columns])
