"""Order-preserving packing of documents into training windows.

Documents keep their order: by doc_id, then by a hash of the text. A shard is
a run of SHARD documents in this order, by exact rank, so it doesn't hang on
the partitioning nor on gaps between ids; its last window is filled no further
(a window a shard, of some hundreds). Ranks come from two-level counting over
(doc_id, hash) alone; what is broadcast is the first key of each shard, up to
MAX_BROADCAST_SHARDS, beyond which documents get their shard by a join. Within
a shard the cutting points are sentence ends, and dynamic programming finds
the cuts of least total cost:

    padding of a window             capacity - tokens, where it is not full
    truncation of a window          TRUNCATION * tokens beyond capacity (only
                                    a sentence longer than a window has any)
    cut inside a document           INSIDE at each

The windows that can end at a boundary start in a sliding range of
boundaries, and their cost splits into a part of the start and a part of the
end; so a monotone queue gives each transition in constant time.

A token here is a maximal run of characters that aren't white space, or what
`count` makes of each sentence. With `gaps`, what it counts begins with the
white space before the sentence (before a document, the blank line that is
put between documents), so that the counts add up to that of the window; only
the gap before its first sentence isn't in its text.

Defined results for odd input: null, empty or blank texts hold no token and
are in no window; a sentence longer than a window is one whole, and a very
long document spans as many windows as it needs; a null doc_id comes first;
rows that repeat a doc_id, or all of a row, each count and are spread over
shards like any others; of cuts of equal cost those of longer windows are
taken; an empty table gives no window; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import kernels as K
from .store import Scratch

CAPACITY, SHARD, TRUNCATION, INSIDE = 1024, 1024, 2.0, 16.0
MAX_BROADCAST_SHARDS, SHARDS_A_TASK, MAX_TASKS = 1_000_000, 4, 50_000
SCHEMA = "shard bigint, window int, doc_ids array<bigint>, n_tokens bigint, padding bigint, truncated bigint, text string"


def best_cuts(length: np.ndarray, doc_end: np.ndarray, capacity: int, truncation: float, inside: float) -> list[int]:
    """Ends (exclusive sentence numbers) of the windows of least cost; length > 0 are the sentences' tokens, doc_end says which end a document. Of equal costs the one of longer windows."""
    total = np.concatenate([[0], np.cumsum(length)]).tolist()
    n, last, sizes = len(length), doc_end.tolist(), length.tolist()
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best[i] + total[i], i), both increasing
    for j in range(1, n + 1):
        tj = total[j]
        lo = tj - capacity
        while queue and total[queue[0][1]] < lo:
            queue.popleft()
        if queue:
            v, i = queue[0]
            cost = v - lo
        else:  # the sentence alone is longer than a window
            i = j - 1
            cost = best[i] + truncation * (sizes[i] - capacity)
        if not last[j - 1]:
            cost += inside
        best[j], back[j] = cost, i
        v = cost + tj
        while queue and queue[-1][0] > v:
            queue.pop()
        queue.append((v, j))
    cuts, j = [], n
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, tokens) of every sentence: up to a token that ends in . ! or ?, to a line's end, or to the document's end."""
    t = K.tokens(data, off, K.NONSPACE)
    m = len(t.start)
    if not m:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    final = data[t.end - 1]
    ends = (final == 46) | (final == 33) | (final == 63)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    ends[:-1] |= newline[t.start[1:]] > newline[t.end[:-1]]
    ends[t.first[1:][np.diff(t.first) > 0] - 1] = True
    e = np.flatnonzero(ends)
    s = np.concatenate([[0], e[:-1] + 1])
    doc = np.searchsorted(t.first, s, "right") - 1
    return t.start[s], t.end[e], doc, e - s + 1


def with_gaps(d: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of sentences, each with the white space before it, or a blank line where a document begins."""
    same = np.append(False, doc[1:] == doc[:-1])
    begin = np.where(same, np.roll(end, 1), start)
    size, lead = end - begin, np.where(same, 0, 2)
    off = np.concatenate([[0], np.cumsum(size + lead)])
    out = np.full(int(off[-1]), 10, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[step + np.repeat(off[:-1] + lead, size)] = d[step + np.repeat(begin, size)]
    return out, off


def pack_shard(ids: pa.Array, text: pa.Array, shard: int | None, capacity: int, truncation: float, inside: float, count: Callable | None, gaps: bool = False) -> pa.RecordBatch:
    """Windows of rows that are in order."""
    data, off = K.flat(text)
    start, end, doc, size = sentences(data, off)
    raw = data.tobytes()
    if count is not None:
        size = np.asarray(count(*with_gaps(data, start, end, doc)) if gaps else count(K.strings(raw, start, end)), dtype=np.int64)
        keep = size > 0
        start, end, doc, size = start[keep], end[keep], doc[keep], size[keep]
    rows: list[list] = [[] for _ in range(7)]
    if len(size):
        doc_end = np.append(doc[1:] != doc[:-1], True)
        names, lo, sums = ids.to_pylist(), 0, np.concatenate([[0], np.cumsum(size)])
        for w, hi in enumerate(best_cuts(size, doc_end, capacity, truncation, inside)):
            parts, n, a = [], int(sums[hi] - sums[lo]), lo
            inner = np.flatnonzero(doc_end[lo : hi - 1]) + lo + 1
            for b in [*inner.tolist(), hi]:
                parts.append((names[doc[a]], raw[start[a] : end[b - 1]].decode("utf-8", "replace")))
                a = b
            for col, v in zip(rows, (shard, w, [p[0] for p in parts], n, max(0, capacity - n), max(0, n - capacity), "\n\n".join(p[1] for p in parts)), strict=True):
                col.append(v)
            lo = hi
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
        names=["shard", "window", "doc_ids", "n_tokens", "padding", "truncated", "text"],
    )


def ranked(rows: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(shard, doc_id, h, text, times) of rows (doc_id, h, text): shard is the rank in the order of (doc_id, h) over `size`; a row that is there several times is given once for each shard, with how often."""
    parts = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).withColumn("part", F.spark_partition_id())
    parts = scratch.save(parts)
    # ranges are in order; so many rows as there are partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.sum("n").alias("all"), F.count("*").alias("keys")).withColumn("offset", F.coalesce(F.sum("all").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "h").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.join(F.broadcast(offsets.select("part", "offset")), "part").select("doc_id", "h", "n", (F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))
    starts = scratch.save(starts)
    total, most = starts.agg(F.sum("n"), F.max("n")).first()
    if (total or 0) <= size * MAX_BROADCAST_SHARDS and (most or 1) == 1:
        first = starts.where(F.col("start") % size == 0).orderBy("start").select("doc_id", "h").toPandas()
        return rows.withColumn("shard", shard_of(first)("doc_id", "h")).withColumn("times", F.lit(1))
    once = rows if most == 1 else rows.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    at = starts.select(F.col("doc_id").alias("i"), F.col("h").alias("k"), "start", (F.col("start") + F.col("n")).alias("stop"))
    joined = once.join(at, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).drop("i", "k")
    each = joined.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    times = F.least("stop", (F.col("shard") + 1) * size) - F.greatest("start", F.col("shard") * size)
    return each.select("doc_id", "h", "text", "shard", times.cast("int").alias("times"))


def shard_of(first: pd.DataFrame) -> Callable:
    """A function of columns: the last of the sorted keys that isn't beyond (doc_id, h)."""
    null = first["doc_id"].isna().to_numpy()
    ids, hashes = first["doc_id"].fillna(0).astype("int64").to_numpy(), first["h"].to_numpy()
    n_null = int(null.sum())
    null_hashes, ids, hashes = hashes[:n_null], ids[n_null:], hashes[n_null:]

    @F.pandas_udf(T.LongType())
    def find(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        nameless, k = doc_id.isna().to_numpy(), h.to_numpy()
        i = doc_id.fillna(0).astype("int64").to_numpy()
        lo, hi = np.searchsorted(ids, i), np.searchsorted(ids, i, "right")
        out = n_null + lo - 1
        one = hi - lo == 1
        out[one] += k[one] >= hashes[lo[one]]
        several = hi - lo > 1
        for g in np.unique(lo[several]).tolist():
            mine = several & (lo == g)
            out[mine] += np.searchsorted(hashes[g : hi[mine][0]], k[mine], "right")
        out[nameless] = np.searchsorted(null_hashes, k[nameless], "right") - 1
        return pd.Series(out)

    return find


def pack(
    docs: DataFrame,
    scratch: Scratch,
    capacity: int = CAPACITY,
    shard: int = SHARD,
    truncation: float = TRUNCATION,
    inside: float = INSIDE,
    count: Callable | None = None,
    gaps: bool = False,
) -> DataFrame:
    """Windows of at most `capacity` tokens. A window that is one sentence of more keeps its whole text; `truncated` says how many tokens a trainer will cut. count: of a list of texts, or with `gaps` of bytes and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards arrive sorted; one is held at a time."""
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            times = t.column("times").to_numpy()
            if (times > 1).any():
                t = t.take(pa.array(np.repeat(np.arange(len(times)), times))).combine_chunks()
            one = lambda k: t.column(k).chunk(0) if t.column(k).num_chunks else pa.array([], t.schema.field(k).type)
            return pack_shard(one("doc_id"), one("text"), t.column("shard")[0].as_py(), capacity, truncation, inside, count, gaps)

        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if held and key[a] != current:
                    yield done()
                    held.clear()
                current = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("text is not null")
    placed = ranked(rows, shard, scratch).select("shard", "doc_id", "h", "text", "times")
    n = docs.count() // (shard * SHARDS_A_TASK)
    tasks = min(MAX_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n))
    return placed.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "h").mapInArrow(run, SCHEMA)


def pack_tokens(docs: DataFrame, scratch: Scratch, path: str = bpe.TOKENIZER, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Windows of at most `capacity` tokens of the byte-level vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.Vocabulary(path))
    return pack(docs, scratch, capacity, shard, count=lambda data, off: bpe.counts(data, off, shared.value), gaps=True)
