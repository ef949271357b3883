"""Repeated passages: all windows of WINDOW words that occur more than once.

A count-min sketch decides which windows are worth grouping. What is counted
is not each window but its minimiser, the least of the hashes of the runs of
WINDOW / 2 words in it: equal windows have equal minimisers, so the count of
a minimiser is never below the count of a window of it, and there are some 13
times fewer of them. Partitions send their sketches as the cells they touch,
the merged sketch (DEPTH rows) overestimates, and only windows whose
minimiser is estimated to occur twice go to the second pass, which groups
them exactly. So nothing is lost; a sketch that is too small for its input
only sends more windows to the second pass.

The width of the sketch follows the input up to MAX_CELLS; what is broadcast
is one bit a cell, 64 MB at the most. Beyond (6.4 GB of text) the sketch fills
up, and in the end every window goes to the second pass: eight bytes a word,
some 1.3 times the text. The result is the same with any width.

Words are maximal runs of letters and digits, case-folded. Defined results
for odd input: null texts and texts of fewer than WINDOW words have no
window; very long texts are taken whole; a null doc_id stands for one
document, which comes before all others; rows that repeat a doc_id are copies
of each other like any others (of occurrences at one place of one doc_id, one
counts as the first); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Scratch

WINDOW, DEPTH, BLOCK, MIN_CELLS, MAX_CELLS, BYTES_A_CELL = 50, 2, 1 << 16, 1 << 20, 1 << 28, 24
HELD_RUNS, HELD_ROWS = 4_000_000, 200_000
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours."""
    step = 1
    while step * 2 <= n:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def runs(d: np.ndarray, o: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Windows in runs that share an occurrence of a minimiser: (minimiser, document, first word, first window, windows' hashes); windows of run r are first[r]:first[r + 1]."""
    t = K.tokens(d, o)
    n, gram = len(t.start), window // 2
    if n < window:
        return None
    p = K.prefix_hash(K.token_hashes(d, t))
    at = np.arange(n - gram + 1)
    g = K.span_hash(p, at, at + gram)
    m = _sliding_min(g, window - gram + 1)
    count = np.maximum(np.diff(t.first) - window + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(doc):
        return None
    word = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    at = word + t.first[:-1][doc]
    m = m[at]
    new = np.ones(len(at), bool)
    # another minimiser, or the occurrence of it has just left the window
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | (g[at[:-1]] == m[:-1])
    first = np.flatnonzero(new)
    return m[first], doc[first], word[first], np.append(first, len(at)), K.span_hash(p, at, at + window)


def cells(m: np.ndarray, row: int, n_cells: int) -> np.ndarray:
    return (K.mix(m ^ K.U64(_SEEDS[row])) & K.U64(n_cells - 1)).astype(np.int64)


def sketch(docs: DataFrame, window: int, n_cells: int, scratch: Scratch) -> np.ndarray:
    """Rows x cells / 8: a bit for each cell of the merged sketch whose count is at least two."""

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            m = np.concatenate(held)
            for row in range(DEPTH):
                c = np.sort(cells(m, row, n_cells))
                block = c // BLOCK
                at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                local = (c % BLOCK).astype(np.uint16)
                parts = np.split(local, at[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row * (n_cells // BLOCK) + block[at]), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "cells"]
                )

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            data, off = K.flat(K.lower(batch.column(0)))
            for _, _, d, o in K.slices(data, off):
                if (r := runs(d, o, window)) is not None:
                    held.append(r[0])
                    size += len(r[0])
                    if size > HELD_RUNS:
                        yield from out(held)
                        held, size = [], 0
        if held:
            yield from out(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(BLOCK, np.int64)
        for x in pdf["cells"]:
            count += np.bincount(np.frombuffer(x, np.uint16), minlength=BLOCK)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(count >= 2).tobytes()]})

    merged = (
        docs.select("text")
        .where("text is not null")
        .mapInArrow(touched, "block bigint, cells binary")
        .groupBy("block")
        .applyInPandas(merge, "block bigint, bits binary")
    )
    bits = np.zeros((DEPTH * (n_cells // BLOCK), BLOCK // 8), np.uint8)
    for batch in scratch.save(merged).toArrow().to_batches():
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits[b] = np.frombuffer(x, np.uint8)
    return bits.reshape(DEPTH, n_cells // 8)


def _flagged(bits: np.ndarray, m: np.ndarray) -> np.ndarray:
    ok = np.ones(len(m), bool)
    for row in range(DEPTH):
        c = cells(m, row, bits.shape[1] * 8)
        ok &= (bits[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


class _Grouping:
    """Exact grouping of windows that arrive sorted by minimiser. A minimiser of very many occurrences is held as one row for each of its distinct windows."""

    def __init__(self, window: int):
        self.window = window
        self.m = self.h = np.zeros(0, K.U64)
        self.doc = self.word = np.zeros(0, np.int64)
        self.null, self.told = np.zeros(0, bool), np.zeros(0, bool)

    def add(self, m, doc, null, word, h) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for k, v in (("m", m), ("doc", doc), ("null", null), ("word", word), ("h", h), ("told", np.zeros(len(m), bool))):
            setattr(self, k, np.concatenate([getattr(self, k), v]))
        last = self.m == self.m[-1]
        if last.all() and len(last) < HELD_ROWS:
            return
        yield self.emit(last)

    def emit(self, hold: np.ndarray) -> pa.RecordBatch:
        """Repeated windows of all that is here; of what is held on to, a row of each window stays."""
        order = np.lexsort((self.word, self.doc, ~self.null, ~self.told, self.h, self.m))  # null comes first
        m, h = self.m[order], self.h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
        at = np.flatnonzero(new)
        many = np.repeat(np.diff(np.append(at, len(h))) > 1, np.diff(np.append(at, len(h))))
        lead = np.zeros(len(h), bool)
        lead[at] = True
        say = many & ~self.told[order]
        o = order[say]
        first = lead[say]
        doc, null, word = self.doc[o], self.null[o], self.word[o]
        by = np.lexsort((word, first, doc, null))
        doc, null, word, first = doc[by], null[by], word[by], first[by]
        cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (first[1:] != first[:-1]) | (word[1:] > word[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(doc)) - 1 if len(a) else a
        keep = order[at][hold[order[at]]]
        told = (many | self.told[order])[at][hold[order[at]]]
        for k in ("m", "doc", "null", "word", "h"):
            setattr(self, k, getattr(self, k)[keep])
        self.told = told
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[a], mask=null[a]), pa.array(first[a]), pa.array(word[a]), pa.array(word[b] + self.window)], names=["doc_id", "first", "start_word", "end_word"]
        )


def repeated_passages(docs: DataFrame, scratch: Scratch, window: int = WINDOW, n_cells: int | None = None) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first): maximal runs of words whose every window occurs elsewhere too. first: it is the occurrence, least by (doc_id, word), that deduplication keeps."""
    if n_cells is None:
        size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        n_cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (size // BYTES_A_CELL).bit_length()))
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, window, n_cells, scratch))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.flat(K.lower(batch.column(1)))
            for lo, hi, d, o in K.slices(data, off):
                if (r := runs(d, o, window)) is None:
                    continue
                m, doc, word, first, h = r
                at = np.flatnonzero(_flagged(bits.value, m))
                if not len(at):
                    continue
                size = np.diff(first)[at]
                ends = np.cumsum(size)
                pick = np.arange(ends[-1]) + np.repeat(first[:-1][at] - (ends - size), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m[at].view(np.int64)),
                        batch.column(0).slice(lo, hi - lo).take(pa.array(doc[at])),
                        pa.array(word[at].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(h[pick].view(np.int64))),
                    ],
                    names=["m", "doc_id", "word", "h"],
                )

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Grouping(window)
        for batch in batches:
            for lo in range(0, batch.num_rows, 50_000):
                part = batch.slice(lo, 50_000)
                h = part.column(3)
                size = np.diff(h.offsets.to_numpy())
                rep = lambda x: np.repeat(x, size)  # noqa: E731,B023
                doc = part.column(1)
                word = rep(part.column(2).to_numpy().astype(np.int64)) + np.arange(size.sum()) - rep(np.cumsum(size) - size)
                yield from g.add(
                    rep(part.column(0).to_numpy().view(np.uint64)),
                    rep(doc.fill_null(0).to_numpy(zero_copy_only=False)),
                    rep(np.asarray(doc.is_null())),
                    word,
                    h.flatten().to_numpy().view(np.uint64),
                )
        if len(g.m):
            yield g.emit(np.zeros(len(g.m), bool))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unites the pieces of a passage, which arrive sorted."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            null = np.asarray(batch.column(0).is_null())
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            first, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            if held is not None:
                null, doc, first, a, b = (np.concatenate([[x], y]) for x, y in zip(held, (null, doc, first, a, b), strict=True))
            # a next window that follows directly starts one word later than the last of the piece
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (first[1:] != first[:-1]) | (a[1:] > b[:-1] - window + 1)])
            at = np.flatnonzero(new)
            end = np.maximum.reduceat(b, at)
            held = (null[at[-1]], doc[at[-1]], first[at[-1]], a[at[-1]], end[-1])
            yield from told(null[at[:-1]], doc[at[:-1]], first[at[:-1]], a[at[:-1]], end[:-1])
        if held is not None:
            yield from told(*(np.array([x]) for x in held))

    def told(null, doc, first, a, b) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        if len(doc):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(b - a, pa.int64()), pa.array(first.astype(bool))],
                names=["doc_id", "start_word", "end_word", "n_words", "first"],
            )

    pieces = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .where("text is not null")
        .mapInArrow(suspects, "m bigint, doc_id bigint, word int, h array<bigint>")
        .repartition("m")
        .sortWithinPartitions("m", "doc_id", "word")
        .mapInArrow(group, "doc_id bigint, first boolean, start_word bigint, end_word bigint")
    )
    return (
        pieces.repartition("doc_id")
        .sortWithinPartitions("doc_id", "first", "start_word")
        .mapInArrow(join, "doc_id bigint, start_word bigint, end_word bigint, n_words bigint, first boolean")
    )
