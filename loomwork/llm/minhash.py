"""Near-duplicate documents by MinHash.

One-permutation hashing with optimal densification gives each document a
signature from a single hash of each word shingle; the signature is cut into
bands; members of a band's bucket are linked in stars, so that a bucket never
makes all its pairs; candidate pairs are verified on the whole signatures;
verified pairs are united.

The first member of a bucket is a centre; the next one that no centre so far
is like becomes a centre too, up to CENTRES. Every member is held against each
centre (so that stars that touch grow together), which makes CENTRES * n
comparisons for a bucket of n at most, whatever is in it. Members like none of
CENTRES centres go to finer buckets, of this band and a further one, which are
done in the same way. A bucket streams by, with its centres held.

These links only save comparisons and leave no pair out: once they are united,
the pairs of a bucket that are still of different components are all compared,
whatever their number, in squares of PART members a side (unmet, all_pairs).

Exact copies are one node: union-find sees each signature once.

Defined results for odd input: a null text or one without a word has no
signature and duplicates nothing; a null doc_id is left alone; rows that
repeat a doc_id are one document (the least signature counts); ties between
copies go to the least doc_id; a very long text is hashed whole; an empty
table gives an empty result; columns besides doc_id and text are ignored by
near_duplicates and kept by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import Scratch, components

SHINGLE, BINS, BANDS, WIDTH, THRESHOLD, CENTRES, BLOCK = 3, 128, 32, 4, 0.55, 8, 2048
PART, PAIRS = 1024, 1 << 16  # members of a side of a square, pairs compared at once


def signatures(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """(doc_id, sig binary of `bins` 16-bit values, sig_hash) of every document that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), K.lower(batch.column(1))
            data, off = K.flat(text)
            for lo, hi, d, o in K.slices(data, off):
                t = K.tokens(d, o)
                h, doc = K.shingles(K.token_hashes(d, t), t.first, shingle)
                sig = K.one_permutation(h, doc, hi - lo, bins)
                rows = np.flatnonzero(np.diff(t.first) > 0)
                if not len(rows):
                    continue
                full = K.band_keys(sig[rows], 1, bins)[:, 0].view(np.int64)
                small = np.ascontiguousarray((sig[rows] ^ (sig[rows] >> 16)).astype(np.uint16))
                raw = pa.Array.from_buffers(
                    pa.binary(),
                    len(rows),
                    [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * (2 * bins)), pa.py_buffer(small)],
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows + lo)), raw, pa.array(full)], names=["doc_id", "sig", "sig_hash"]
                )

    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .where("doc_id is not null and text is not null")
        .mapInArrow(run, "doc_id bigint, sig binary, sig_hash bigint")
    )


def _unpacked(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(len(sig), -1)


@F.pandas_udf(T.DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal signature values: the estimate of the Jaccard similarity."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(a), -1)
    return pd.Series((x == y).mean(axis=1))


def meeting(rows: DataFrame) -> DataFrame:
    """(bucket, id) of those that aren't alone in their bucket. Sorted runs are streamed: no bucket is ever held in memory."""
    w = Window.partitionBy("bucket").orderBy("id")
    return rows.select("bucket", "id", F.lag("id").over(w).alias("_a"), F.lead("id").over(w).alias("_b")).where("_a is not null or _b is not null").select("bucket", "id")


Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]


def link_block(bucket: np.ndarray, held: int, alike: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their centres, rows like no centre, centres) of buckets, which are sorted; the first `held` rows are centres of the first bucket already. All buckets take a centre together, CENTRES times; pairs that this leaves apart are for all_pairs."""
    n = len(bucket)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    is_centre, told = np.zeros(n, bool), np.zeros(n, bool)
    rows, centres = [], []
    for r in range(CENTRES):
        if r < held:  # of the first bucket its next held centre, of others their first that is like none
            free = np.flatnonzero(~told & ~is_centre & (group > 0))
            free = np.concatenate([[r], free])
        else:
            free = np.flatnonzero(~told & ~is_centre & (np.arange(n) >= held))
        if not len(free):
            break
        c = free[np.concatenate([[True], group[free][1:] != group[free][:-1]])]
        is_centre[c] = True
        of = np.full(len(starts), -1)
        of[group[c]] = c
        # centres have met all rows before, those held have met each other
        mine = np.flatnonzero((of[group] >= 0) & ~is_centre & (np.arange(n) >= held))
        ok = alike(mine, of[group[mine]])
        told[mine[ok]] = True
        rows.append(mine[ok])
        centres.append(of[group[mine[ok]]])
    none = np.flatnonzero(~told & ~is_centre & (np.arange(n) >= held))
    z = np.zeros(0, np.int64)
    return np.concatenate(rows or [z]), np.concatenate(centres or [z]), none, np.flatnonzero(is_centre | (np.arange(n) < held))


def link_buckets(rows: DataFrame, compare: Callable[[list[bytes]], Alike]) -> DataFrame:
    """(bucket, id, centre) of (bucket, id, what): members with each centre that they are like; a null centre for those like none of CENTRES, and for centres that members of earlier blocks haven't met. compare makes of `what` of a block the comparison of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, what, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def done(b: np.ndarray, i: np.ndarray, w: list[bytes], held: int) -> tuple[pa.RecordBatch, np.ndarray]:
            r, c, none, centres = link_block(b, held, compare(w))
            if held:
                none = np.concatenate([none, centres[(centres >= held) & (b[centres] == b[0])]])
            row = np.concatenate([r, none])
            to = np.concatenate([i[c], np.zeros(len(none), np.int64)])
            batch = [pa.array(b[row]), pa.array(i[row]), pa.array(to, mask=np.arange(len(row)) >= len(r))]
            return pa.RecordBatch.from_arrays(batch, names=["bucket", "id", "centre"]), centres

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                bucket = np.concatenate([bucket, part.column(0).to_numpy()])
                ids = np.concatenate([ids, part.column(1).to_numpy()])
                what += part.column(2).to_pylist()
                while len(bucket) >= BLOCK:
                    # whole buckets, or, of one that is longer, a part, whose centres are held on to
                    cut = int(np.searchsorted(-(bucket[:BLOCK] != bucket[BLOCK - 1]).astype(np.int8), 0))
                    cut = cut or BLOCK
                    out, centres = done(bucket[:cut], ids[:cut], what[:cut], held)
                    yield out
                    on = centres[bucket[centres] == bucket[BLOCK - 1]] if cut == BLOCK else centres[:0]
                    bucket, ids = np.concatenate([bucket[on], bucket[cut:]]), np.concatenate([ids[on], ids[cut:]])
                    what, held = [what[i] for i in on] + what[cut:], len(on)
        if len(bucket) > held:
            yield done(bucket, ids, what, held)[0]

    drawn = rows.select("bucket", "id", "what").repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("id", "bucket"), "id")
    return drawn.mapInArrow(run, "bucket bigint, id bigint, centre bigint")


def unmet(found: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, id, root, block, blocks) of those of link_buckets' result that share a bucket with one of another component. Who isn't there was a centre and has met all of its bucket."""
    those = found.select("bucket", "id").distinct().join(comp, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    those = scratch.save(those)
    several = those.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    part = lambda c: F.floor(c / PART).cast("int")
    return scratch.save(those.join(several, "bucket").select("bucket", "id", "root", part(place).alias("block"), (part(F.col("n") - 1) + 1).alias("blocks")))


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, about PAIRS at a time; groups are sorted."""
    n = len(group)
    end = np.searchsorted(group, group, "right")
    count = end - np.arange(n) - 1
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1, [n]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        a = np.repeat(np.arange(lo, hi), count[lo:hi])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])


def all_pairs(members: DataFrame, what: DataFrame, compare: Callable[[list[bytes]], Alike]) -> DataFrame:
    """(a, b) of components that two members of a bucket, which are alike, are of. members: as unmet has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        texts: list[bytes] = []

        def done(cut: int) -> pa.RecordBatch:
            bucket, i, j, root, block = (x[:cut] for x in kept)
            alike = compare(texts[:cut])
            group = np.cumsum(np.concatenate([[False], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            out = np.zeros((0, 2), np.int64)
            for a, b in pairs_within(group):
                # of two blocks, the pairs across; those of a block are made where it meets itself
                ok = (root[a] != root[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
                a, b = a[ok], b[ok]
                ok = alike(a, b)
                out = np.unique(np.concatenate([out, np.sort(np.stack([root[a[ok]], root[b[ok]]], axis=1), axis=1)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK // 2):
                part = batch.slice(lo, BLOCK // 2)
                kept = [np.concatenate([x, part.column(k).to_numpy()]) for k, x in enumerate(kept)]
                texts += part.column(5).to_pylist()
                while len(texts) > BLOCK:
                    # whole squares, of at most 2 * PART rows each
                    last = np.all([x[:BLOCK] == x[BLOCK] for x in kept[:3]], axis=0)
                    cut = BLOCK - int(last.sum())
                    if not cut:
                        break
                    yield done(cut)
                    kept, texts = [x[cut:] for x in kept], texts[cut:]
        if texts:
            yield done(len(texts))

    squares = members.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
        "bucket", F.least("block", "other").cast("bigint").alias("i"), F.greatest("block", "other").cast("bigint").alias("j"), "root", F.col("block").cast("bigint").alias("block"), "id"
    )
    drawn = squares.join(what, "id").select("bucket", "i", "j", "root", "block", "what").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return drawn.mapInArrow(run, "a bigint, b bigint").distinct()


def unlike_buckets(rows: DataFrame) -> DataFrame:
    """rows (bucket, id), of buckets that have the same members, those of one alone: the others would give the same pairs. Members are told by their number, the least, the largest and 128 bits of all."""
    each = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    return rows.join(each.groupBy("n", "lo", "hi", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def linked(rows: DataFrame, keys: DataFrame, what: DataFrame, compare: Callable[[list[bytes]], Alike], scratch: Scratch) -> DataFrame:
    """(a, b): each a of rows (bucket, id) that is linked, by alike ones that meet, to a lesser one, and the least of those. keys: (id, buckets), all buckets of each id, those of a band at one place; what: (id, what)."""
    found = scratch.save(link_buckets(unlike_buckets(rows).join(what, "id"), compare))
    none = found.where("centre is null").select("bucket", "id")
    out = found.where("centre is not null")
    if not none.isEmpty():
        also = F.expr("explode(transform(array(1, 2), k -> buckets[pmod(array_position(buckets, bucket) - 1 + k, size(buckets))]))")
        finer = none.join(keys, "id").select("bucket", "id", also.alias("also")).select(F.xxhash64("bucket", "also").alias("bucket"), "id")
        more = scratch.save(link_buckets(meeting(finer).join(what, "id"), compare))
        out = out.unionByName(more.where("centre is not null"))
    comp = scratch.save(components(out.select(F.col("id").alias("a"), F.col("centre").alias("b")), scratch))
    within = comp.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    members = unmet(found, comp, scratch)
    if members.isEmpty():
        return within
    more = scratch.save(all_pairs(members, what, compare))
    if more.isEmpty():
        return within
    joined = scratch.save(components(more, scratch)).where("id <> root")
    moved = within.join(joined, F.col("b") == F.col("id"), "left").select("a", F.coalesce("root", "b").alias("b"))
    return moved.unionByName(joined.select(F.col("id").alias("a"), F.col("root").alias("b")))


def near_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    shingle: int = SHINGLE,
    bins: int = BINS,
    bands: int = BANDS,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, rep_id, similarity) of every document that goes; rep_id is the document of its group that stays, similarity the estimate between the two."""
    sigs = scratch.save(
        signatures(docs, shingle, bins).groupBy("doc_id").agg(F.min(F.struct("sig_hash", "sig")).alias("s")).select("doc_id", "s.*")
    )
    # documents of one signature are copies: only the least of them goes on
    copies = scratch.save(sigs.groupBy("sig_hash").agg(F.min(F.struct("doc_id", "sig")).alias("s"), F.count("*").alias("n")).select("sig_hash", F.col("s.doc_id").alias("rep"), "s.sig", "n"))
    banded = lambda sig: K.band_keys(sig, bands, width)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bucket, ids = banded(_unpacked(batch.column(1))).ravel(), np.repeat(batch.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keyed = banded(_unpacked(batch.column(1))).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keyed) + 1, dtype=np.int32) * bands), pa.array(keyed.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "buckets"])

    reps = copies.select("rep", "sig")
    rows = scratch.save(meeting(reps.mapInArrow(members, "bucket bigint, id bigint")))

    def compare(sigs: list[bytes]) -> Alike:
        x = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), bins)
        return lambda a, b: (x[a] == x[b]).mean(axis=1) >= threshold if len(a) else np.zeros(0, bool)

    keyed = reps.mapInArrow(all_keys, "id bigint, buckets array<bigint>")
    to = linked(rows, keyed, reps.select(F.col("rep").alias("id"), F.col("sig").alias("what")), compare, scratch)
    root = copies.where("n > 1").join(to, F.col("rep") == F.col("a"), "full").select(F.coalesce("rep", "a").alias("rep"), F.coalesce("b", "rep").alias("rep_id"))
    # every document of a signature goes where the least of them goes
    of = sigs.select("doc_id", "sig_hash", F.col("sig").alias("sig_a")).join(copies.select("sig_hash", "rep"), "sig_hash").join(root, "rep").where("doc_id <> rep_id")
    r = reps.select(F.col("rep").alias("rep_id"), F.col("sig").alias("sig_b"))
    out = scratch.save(of.join(r, "rep_id").select("doc_id", "rep_id", agreement("sig_a", "sig_b").alias("similarity")))
    return scratch.only(out)


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, **how: float) -> DataFrame:
    """docs without the documents that near_duplicates names."""
    gone = near_duplicates(docs, scratch, **how).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
