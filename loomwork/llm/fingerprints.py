"""Threshold-scaled sketches of documents (FracMinHash).

A sketch keeps every shingle hash below a fixed fraction of the hash range:
1 / SCALED of the distinct shingles, whatever the document's length. So
sketches of very unequal documents are comparable, the sketch of a union is
the union of the sketches, and |A and B| / |A| of the sketches estimates how
much of A is contained in B.

Passages are not sketched: a benchmark item is short, and a fraction of its
shingles may be none. A document is held against all shingles of each item;
of its hashes beyond the fraction only those that an item has are kept.

Defined results for odd input: a null or wordless text has an empty sketch,
and its containments are null; rows that repeat a doc_id are one document
(the union of their sketches); a null doc_id is one document as well; rows
that repeat an item_id are one item, of the union of their shingles; an item
of fewer words than a shingle has one shingle, one without a word is in no
document; a share of just `passage` counts as contained; very long texts are
hashed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Scratch

SHINGLE, SCALED, PASSAGE, BROADCAST_HASHES = 4, 8, 0.6, 1_000_000


def sketches(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, scaled: int = SCALED, also: Broadcast | None = None) -> DataFrame:
    """(key, sketch): the sorted distinct hashes below 2^64 / scaled of each row; if there is `also`, an array of hashes, a column hits as well: those of it that the row has, below or not."""
    names, types = [key, "sketch"] + ["hits"] * (also is not None), f"{key} bigint, sketch array<bigint>" + ", hits array<bigint>" * (also is not None)
    limit = np.uint64((1 << 64) // scaled - 1)

    def distinct(h: np.ndarray, doc: np.ndarray, rows: int) -> pa.ListArray:
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        at = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if also is None else K.HashTable(also.value)
        for batch in batches:
            data, off = K.flat(K.lower(batch.column(1)))
            for lo, hi, d, o in K.slices(data, off):
                t = K.tokens(d, o)
                h, doc = K.shingles(K.token_hashes(d, t), t.first, shingle)
                columns = [distinct(h[keep], doc[keep], hi - lo) for keep in ([h <= limit] if table is None else [h <= limit, table.find(h) >= 0])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=names)

    return docs.select(F.col(key).cast("bigint").alias(key), "text").mapInArrow(run, types)


def merge(sketched: DataFrame, *by: str) -> DataFrame:
    """The sketches of unions: one of each value of `by`."""
    return sketched.select(*by, F.explode("sketch").alias("h")).groupBy(*by).agg(F.array_sort(F.collect_set("h")).alias("sketch"))


def containment(a: str, b: str):  # noqa: ANN201
    """Column: the estimated share of sketch a's document that b's holds; null for an empty sketch."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a))


def fingerprints(docs: DataFrame, passages: DataFrame, scratch: Scratch, shingle: int = SHINGLE, scaled: int = SCALED, passage: float = PASSAGE) -> DataFrame:
    """For each doc_id: its sketch, the estimated number of distinct shingles, in_others (how much of it the rest of the corpus contains, together) and items (the item_id of each passage of which at least the share `passage` of all shingles is in the document).

    Containment in all other documents needs no pair of documents: a hash
    that one document alone has is counted for it, with partial aggregation,
    so neither a hash that all documents share nor a group of copies costs
    more than others.
    """
    whole = sketches(passages, "item_id", shingle, 1).select("item_id", F.explode("sketch").alias("h")).distinct()
    whole = scratch.save(whole)
    items = whole.join(whole.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("size")), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    wanted = whole.select("h").distinct()
    few = wanted.count() <= BROADCAST_HASHES
    also = docs.sparkSession.sparkContext.broadcast(wanted.toArrow().column("h").to_numpy().view(np.uint64)) if few else None
    mine = sketches(docs, "doc_id", shingle, scaled, also)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    rows = scratch.save(
        mine.groupBy("doc_id").agg(*[union(c) for c in mine.columns[1:]])
        if docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
        else mine
    )
    hashes = rows.select("doc_id", F.explode("sketch").alias("h"))
    own = (
        hashes.groupBy("h")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
        .where("n = 1")
        .groupBy("doc_id")
        .agg(F.count("*").alias("own"))
    )
    if few:
        hits, items = rows.select("doc_id", F.explode("hits").alias("h")), F.broadcast(items)
    else:
        hits = sketches(docs, "doc_id", shingle, 1).select("doc_id", F.explode("sketch").alias("h")).join(wanted, "h", "left_semi").distinct()
    held = (
        hits.join(items, "h")
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .where(F.col("n") >= F.lit(passage) * F.col("size"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    extra = own.select("doc_id", "own", F.lit(None).cast("array<bigint>").alias("items")).unionByName(
        held.select("doc_id", F.lit(None).cast("bigint").alias("own"), "items")
    )
    extra = extra.groupBy(F.col("doc_id").alias("id")).agg(F.max("own").alias("own"), F.max("items").alias("items"))
    size = F.size("sketch")
    return rows.join(extra, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id",
        (size * scaled).cast("bigint").alias("n_shingles"),
        F.round(F.try_divide((size - F.coalesce("own", F.lit(0))).cast("double"), size), 6).alias("in_others"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        "sketch",
    )
