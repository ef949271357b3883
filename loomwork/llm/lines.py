"""Fuzzy line deduplication.

Each distinct line gets a MinHash signature over its character shingles (of
the case-folded line); bands propose pairs, in stars as for documents; pairs
are verified by the exact Jaccard similarity of their shingle sets;
distributed union-find makes components; and of each component the one
occurrence that comes first, by (doc_id, line), stays.

Lines of fewer than SHORT bytes are compared by shingles of 4 bytes, so that
one edit inside a line of 30 bytes leaves it alike; lines of at least LONG by
shingles of 8, which random lines hardly share, so that buckets stay small
whatever the number of lines. Lines between the two are compared both ways;
lines of which one is below LONG and the other not below SHORT are too
unequal in length to be alike.

Texts are never shuffled whole: a first pass sends signatures, a second one
only the lines that have a partner proposed, and a third cuts lines out. The
sets that passes two and three look up are broadcast while they are of at
most MAX_BROADCAST_LINES lines, and joined beyond that.

Defined results for odd input: null, empty and blank texts have no line and
stay as they are; blank lines are never cut; a document whose every line is
cut goes; lines shorter than a shingle have one shingle, so they equal only
the same line; very long lines and texts are taken whole; of like lines that
tie for the first place (rows that repeat a doc_id and a line are the same
occurrence) all stay; a null doc_id comes before all others; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .minhash import Alike, linked, meeting
from .store import Scratch, unused

# shingle, bands, values a band, least similarity: of long lines and of short ones
LONG_LINES, SHORT_LINES = (8, 8, 5, 0.8), (4, 16, 5, 0.7)
LONG, SHORT = 64, 96
MAX_BROADCAST_LINES = 4_000_000
RUN = 1 << 15  # bytes of lines that are hashed at once
NO_ID = -(1 << 63)

_BLANK = bytes(np.flatnonzero(~K.NONSPACE).tolist())
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD_SUM = _FOLD.astype(K.U64) + K.U64(1)
_FOLD_SUM[10] = 0  # line ends, which follow lines, count for nothing


def split(data: np.ndarray, off: np.ndarray) -> tuple[K.Tokens, np.ndarray, np.ndarray]:
    """(all lines of at least a byte, which of them aren't blank, hash of each)."""
    t = K.tokens(data, off, inside=data != 10)
    # most lines show by their first byte that they aren't blank
    ink = K.NONSPACE[data[t.start]]
    for i in np.flatnonzero(~ink).tolist():
        ink[i] = bool(data[t.start[i] : t.end[i]].tobytes().strip(_BLANK))
    # between lines there are line ends only
    uid = np.zeros(len(t.start), K.U64)
    for lo, hi, a, b in runs(t.start, t.end):
        start, end = t.start[lo:hi] - a, t.end[lo:hi] - a
        uid[lo:hi] = K.sum_hash(_FOLD_SUM.take(data[a:b]), start, end)
    return t, ink, uid


def runs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first line, end line, first byte, end byte) of runs of ascending lines of about RUN bytes, so that what is made of them stays in a cache; a longer line is a run of its own."""
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + RUN, "right")))
        yield lo, hi, int(start[lo]), int(end[hi - 1])
        lo = hi


def byte_shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of each run of n (4 or 8) case-folded bytes of each span, one for a shorter span."""
    folded = np.zeros(len(data) + 8, np.uint8)
    _FOLD.take(data, out=folded[: len(data)])
    # the n bytes from each place on, as one little-endian number
    x = np.ndarray((len(data) + 1,), "<u8" if n == 8 else "<u4", folded, 0, (1,))
    size = end - start
    count = np.maximum(size - n + 1, 1)
    line = np.repeat(np.arange(len(start)), count)
    if (size > 0).all():  # where shingles begin: spans ascend and don't overlap
        turns = np.zeros((len(start), 2), np.int64)
        turns[:, 1] = count
        turns[:, 0] = start
        turns[1:, 0] -= start[:-1] + count[:-1]
        begins = np.repeat(np.tile([False, True], len(start)), turns.ravel())
        g = x[: len(begins)][begins].astype(K.U64)
    else:
        g = x[np.arange(len(line)) - np.repeat(np.cumsum(count) - count - start, count)].astype(K.U64)
    short = size < n
    if short.any():
        at = (np.cumsum(count) - count)[short]
        g[at] = (g[at] & ((K.U64(1) << (K.U64(8) * size[short].astype(K.U64))) - K.U64(1))) + K.U64(0x0100000000000000) * size[short].astype(K.U64)
    return K.mix(g), line


def line_buckets(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, line), in the order of lines, of all bands of each line."""
    kinds = []
    for n, bands, width, _ in (LONG_LINES, SHORT_LINES):
        mine = np.flatnonzero(end - start >= LONG if n == LONG_LINES[0] else end - start < SHORT)
        kinds.append((n, bands, width, mine, np.full(len(mine) * bands * width, K.EMPTY, np.uint32)))
    for lo, hi, a, b in runs(start, end):
        for n, bands, width, mine, sig in kinds:
            i, j = np.searchsorted(mine, (lo, hi)).tolist()
            if i == j:
                continue
            first, stop, data = start[mine[i:j]] - a, end[mine[i:j]] - a, d[a:b]
            size = stop - first
            stop_at = np.cumsum(size)
            if 2 * stop_at[-1] < b - a:  # few of the bytes: they are put together
                data = data[np.arange(stop_at[-1]) + np.repeat(stop - stop_at, size)]
                first, stop = stop_at - size, stop_at
            h, line = byte_shingles(data, first, stop, n)
            K.fill_bins(sig, h, (line + i) * (bands * width), bands * width)
    keys, who = [], []
    for n, bands, width, mine, sig in kinds:
        sig = K.densify(sig.reshape(len(mine), bands * width))
        keys.append((K.band_keys(sig, bands, width) ^ K.U64(n)).ravel())
        who.append(np.repeat(mine, bands))
    key, line = np.concatenate(keys), np.concatenate(who)
    order = np.argsort(line, kind="stable")
    return key[order], line[order]


def scan(docs: DataFrame) -> DataFrame:
    """(uid, buckets, doc_id, line, n): each batch's distinct lines, where the first is and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, off = K.flat(batch.column(1))
            for lo, hi, d, o in K.slices(data, off):
                t, ok, uid = split(d, o)
                doc, at = t.doc, np.flatnonzero(ok)
                if not len(at):
                    continue
                number = np.arange(len(doc)) - t.first[doc]
                order = at[np.lexsort((number[at], ids[lo:hi][doc[at]], uid[at]))]
                u = uid[order]
                first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                one = np.sort(order[first])
                n = np.zeros(len(doc), np.int64)
                n[order[first]] = np.diff(np.append(first, len(u)))
                key, line = line_buckets(d, t.start[one], t.end[one])
                mine = uid[one].view(np.int64)
                first_key = np.searchsorted(line, np.arange(len(one) + 1)).astype(np.int32)

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mine),
                        pa.ListArray.from_arrays(pa.array(first_key), pa.array(key.view(np.int64))),
                        pa.array(ids[lo:hi][doc[one]]),
                        pa.array(number[one].astype(np.int32)),
                        pa.array(n[one]),
                    ],
                    names=["uid", "buckets", "doc_id", "line", "n"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(
        run, "uid bigint, buckets array<bigint>, doc_id bigint, line int, n bigint"
    )


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, text) of the wanted lines, each once."""
    n = wanted.count()
    keys = None
    if n <= MAX_BROADCAST_LINES:
        got = wanted.toArrow().column("uid").to_numpy().view(np.uint64)
        keys = docs.sparkSession.sparkContext.broadcast(K.Lookup(np.sort(got)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if keys is None else keys.value.table
        for batch in batches:
            data, off = K.flat(batch.column(0))
            for _, _, d, o in K.slices(data, off):
                t, ok, uid = split(d, o)
                at = np.flatnonzero(ok if table is None else ok & (table.find(uid) >= 0))
                _, one = np.unique(uid[at], return_index=True)
                at, raw = at[one], d.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[at].view(np.int64)), pa.array([raw[a:b] for a, b in zip(t.start[at].tolist(), t.end[at].tolist(), strict=True)], pa.binary())],
                    names=["uid", "text"],
                )

    found = docs.select("text").where("text is not null").mapInArrow(run, "uid bigint, text binary")
    if keys is None:
        found = found.join(wanted, "uid", "left_semi")
    return found.groupBy("uid").agg(F.first("text").alias("text"))


class ShingleSets:
    """The sets of shingles of n bytes of at most 4096 texts, as 52 bits of a hash of each."""

    def __init__(self, texts: list[bytes], n: int):
        size = np.array([len(x) for x in texts], np.int64)
        end = np.cumsum(size)
        data, start, sets = np.frombuffer(b"".join(texts), np.uint8), end - size, [np.zeros(0, K.U64)]
        for lo, hi, a, b in runs(start, end):
            h, line = byte_shingles(data[a:b], start[lo:hi] - a, end[lo:hi] - a, n)
            key = np.sort((line + lo).astype(K.U64) << K.U64(52) | h >> K.U64(12))
            sets.append(key[np.concatenate([[True], key[1:] != key[:-1]])])
        self.keys = np.concatenate(sets)
        self.first = np.searchsorted(self.keys, np.arange(len(texts) + 1, dtype=K.U64) << K.U64(52))
        told = np.zeros((len(texts), 1024), bool)
        told[(self.keys >> K.U64(52)).astype(np.int64), (self.keys & K.U64(1023)).astype(np.int64)] = True
        self.marks = np.packbits(told, axis=1).view(np.uint64)

    def at_least(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Whether pairs are of at least that exact similarity. Sets differ by no fewer shingles than their marks do by bits, so that most are told by these."""
        size, out = np.diff(self.first), np.zeros(len(a), bool)
        apart = np.bitwise_count(self.marks[a] ^ self.marks[b]).sum(axis=1, dtype=np.int64)
        maybe = np.flatnonzero(apart * (1 + least) <= (1 - least) * (size[a] + size[b]) + 1e-6)
        out[maybe] = self.jaccard(a[maybe], b[maybe]) >= least
        return out

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact similarity of each pair of texts, by their numbers."""
        size, out = np.diff(self.first), np.zeros(len(a))
        # so many pairs at once that their shingles are few
        parts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size[a]) >> 19)) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
        for lo, hi in zip(parts[:-1].tolist(), parts[1:].tolist()):
            x, y = a[lo:hi], b[lo:hi]
            pair = np.repeat(np.arange(len(x)), size[x])
            at = np.arange(len(pair)) - np.repeat(np.cumsum(size[x]) - size[x] - self.first[x], size[x])
            key = self.keys[at] & K.U64((1 << 52) - 1) | y[pair].astype(K.U64) << K.U64(52)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            common = np.bincount(pair[self.keys[place] == key], minlength=len(x))
            out[lo:hi] = common / (size[x] + size[y] - common)
        return out


def compare(texts: list[bytes]) -> Alike:
    """Whether pairs of the texts are alike, by the shingles that their lengths call for."""
    size = np.array([len(x) for x in texts], np.int64)
    sets = []
    for (n, _, _, least), mine in ((LONG_LINES, size >= LONG), (SHORT_LINES, size < SHORT)):
        rows = np.flatnonzero(mine)
        if len(rows):
            sets.append((ShingleSets([texts[i] for i in rows], n), np.cumsum(mine) - 1, mine, least))

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for s, number, mine, least in sets:
            pairs = np.flatnonzero(mine[a] & mine[b] & ~out)
            out[pairs] = s.at_least(number[a[pairs]], number[b[pairs]], least)
        return out

    return alike


def keepers(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, doc_id, line) of each line that isn't alone in its component, and the occurrence that stays."""
    lines = scratch.save(scan(docs))
    # lines that other batches have too go on once
    each = scratch.save(lines.groupBy("uid").agg(F.min(F.struct("doc_id", "line", "buckets")).alias("x"), F.sum("n").alias("n")).select("uid", F.struct("x.doc_id", "x.line").alias("at"), "n", "x.buckets"))
    rows = scratch.save(meeting(each.select(F.explode("buckets").alias("bucket"), F.col("uid").alias("id"))))
    scratch.drop(lines)
    texts = scratch.save(_texts(docs, rows.select(F.col("id").alias("uid")).distinct()))
    good = linked(rows, each.select(F.col("uid").alias("id"), "buckets"), texts.select(F.col("uid").alias("id"), F.col("text").alias("what")), compare, scratch)
    good = scratch.save(good.select(F.col("a").alias("id"), F.col("b").alias("root")))
    comp = good.unionByName(good.select(F.col("root").alias("id"), "root").distinct())
    united = each.select("uid", "at").join(comp.withColumnRenamed("id", "uid"), "uid")
    least = united.groupBy("root").agg(F.min("at").alias("at"))
    several = united.select("uid", "root").join(least, "root").select("uid", "at.*")
    alone = each.where("n > 1").select("uid", "at").join(comp.select(F.col("id").alias("uid")), "uid", "left_anti").select("uid", "at.*")
    return scratch.only(scratch.save(several.union(alone)))


def _without(d: np.ndarray, o: np.ndarray, t: K.Tokens, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets without the dropped lines and their line ends."""
    doc, start = t.doc[drop], t.start[drop]
    stop = np.minimum(t.end[drop] + 1, o[1:][doc])
    turns = np.zeros((len(drop), 2), np.int64)
    turns[:, 1] = stop - start
    turns[:, 0] = start
    turns[1:, 0] -= stop[:-1]
    keep = np.ones(len(d), bool)
    keep[: stop[-1]] = np.repeat(np.tile([True, False], len(drop)), turns.ravel())
    new, size = d[keep], np.diff(o)
    np.subtract.at(size, doc, stop - start)
    # a document that had no line end at its end gets none
    touched = np.unique(doc)
    touched = touched[size[touched] > 0]
    last = np.cumsum(size)[touched] - 1
    more = (new[last] == 10) & (d[o[1:][touched] - 1] != 10)
    size[touched[more]] -= 1
    return np.delete(new, last[more]), np.concatenate([[0], np.cumsum(size)])


def cut_lines(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """docs without the occurrences of the lines in `keep` that aren't the ones that stay."""
    names, spark = docs.columns, docs.sparkSession
    if keep.count() > MAX_BROADCAST_LINES:
        return _cut_by_join(docs, keep)
    k = keep.toArrow()
    shared = spark.sparkContext.broadcast((K.Lookup(k.column("uid").to_numpy().view(np.uint64)), k.column("doc_id").to_numpy(), k.column("line").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, docs_, lines_ = shared.value
        table = uids.table
        for batch in batches:
            text = K.string_column(batch, "text")
            ids = K.string_column(batch, "doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, off = K.flat(text)
            for lo, hi, d, o in K.slices(data, off):
                t, ok, uid = split(d, o)
                row = table.find(uid)
                at = np.flatnonzero(ok & (row >= 0))
                doc = t.doc[at]
                drop = at[(docs_[row[at]] != ids[lo:hi][doc]) | (lines_[row[at]] != at - t.first[doc])]
                yield _rebuilt(batch.slice(lo, hi - lo), names, d, o, t, ok, drop)

    return docs.mapInArrow(run, docs.schema)


def _rebuilt(part: pa.RecordBatch, names: list[str], d: np.ndarray, o: np.ndarray, t: K.Tokens, ok: np.ndarray, drop: np.ndarray) -> pa.RecordBatch:
    if not len(drop):
        return part
    cut = np.bincount(t.doc[drop], minlength=len(o) - 1)
    had = np.bincount(t.doc[ok], minlength=len(o) - 1)
    new, at = _without(d, o, t, drop)
    i = names.index("text")
    old = part.column(i)
    made = pa.LargeStringArray.from_buffers(len(old), pa.py_buffer(np.ascontiguousarray(at.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(new)))
    if old.null_count:
        made = pa.array(made.to_pylist(), pa.large_string(), mask=np.asarray(old.is_null()))
    columns = [made.cast(old.type) if j == i else part.column(j) for j in range(part.num_columns)]
    return pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array((cut == 0) | (cut < had)))


def _cut_by_join(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """cut_lines for a set too large to broadcast: the positions to drop are found by a join and sent to their documents."""
    names = docs.columns

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.flat(batch.column(1))
            for lo, _, d, o in K.slices(data, off):
                t, ok, uid = split(d, o)
                at = np.flatnonzero(ok)
                doc = t.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[at].view(np.int64)), batch.column(0).take(pa.array(doc + lo)), pa.array((at - t.first[doc]).astype(np.int32)), batch.column(2).take(pa.array(doc + lo))], names=["uid", "own", "number", "key"]
                )

    places = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("key")).where("text is not null").mapInArrow(
        positions, "uid bigint, own bigint, number int, key bigint"
    )
    # by text as well: the rows of one doc_id, such as null, may be any number
    drops = (
        places.join(keep, "uid")
        .where("own <> doc_id or number <> line")
        .select("own", "key", F.struct("number", "uid").alias("x"))
        .groupBy("own", "key")
        .agg(F.collect_set("x").alias("_drop"))
    )
    joined = docs.join(drops, (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == drops["own"]) & (F.xxhash64(docs["text"]) == drops["key"]), "left")
    joined = joined.select(*[docs[c] for c in names], drops["_drop"].alias(unused("_drop", names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [{(x["number"], x["uid"]) for x in g or ()} for g in batch.column(batch.num_columns - 1).to_pylist()]
            batch = pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
            data, off = K.flat(K.string_column(batch, "text"))
            for lo, hi, d, o in K.slices(data, off):
                t, ok, uid = split(d, o)
                doc, u = t.doc, uid.view(np.int64).tolist()
                drop = np.array([i for i in np.flatnonzero(ok).tolist() if (i - t.first[doc[i]], u[i]) in gone[lo + doc[i]]], dtype=np.int64)
                yield _rebuilt(batch.slice(lo, hi - lo), names, d, o, t, ok, drop)

    return joined.mapInArrow(run, docs.schema)


def drop_duplicate_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with one occurrence of each group of like lines."""
    return cut_lines(docs, keepers(docs, scratch))
