"""Exact top-k search by no-random-access aggregation over sorted lists.

Objects are put together with those that are near the same one of PIVOTS
objects and cut into blocks. A block has one sorted list a dimension, made
once and stored. Its own queries are held against it at first, which gives
each query a floor: the k-th best score so far. Then blocks of queries meet
blocks of objects, of which the lists are read from the ends that a query's
signs prefer, to a common depth:

    an object that no list has shown yet scores at most the sum, over the
    dimensions, of the weight times the next value of the list: the threshold

At depth 0 no object has been shown, so a block whose threshold is below the
floor is left alone, unread. Else the depth grows (DEPTHS); as soon as the
threshold is below the floor, outsiders can't qualify, and the scores of the
objects that were shown are resolved; if that takes more than the last depth,
those of the whole block are. So no pair costs more than its score, and the
threshold of a block costs as much as one.

Queries are the rows whose id is divisible by `every` (20 in the registered
query), objects are all rows. Blocks meet in a product of partitions, each
with its own running top k, merged at the end; nothing is broadcast but the
pivots, of which there are PIVOTS at most: they decide what is near what in
storage, not what is found. The score is the cosine.

Defined results for odd input: rows with a null id, a null vector, null or
non-finite elements, no length, or another dimension than the most common one
are neither queries nor found; of rows that repeat an id the least vector
counts; ties in the score (rounded to 6 digits) go to the lesser id; vectors
of any width are taken whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

TOP, EVERY, BLOCK, PIVOTS, DEPTHS, OBJECT_BLOCKS, SLACK = 10, 1, 1024, 256, (0, 1 / 256, 1 / 64), 64, 2e-6
_NONE = np.iinfo(np.int64).max


class SortedLists:
    """The lists of a block of objects: `order` has, for each dimension, the objects by ascending value. made counts multiplications."""

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None):
        self.x, self.made = x, 0
        self.order = np.argsort(x, axis=0).astype(np.int32) if order is None else order
        self.at = np.arange(x.shape[1])

    def threshold(self, signed: np.ndarray, depth: int) -> np.ndarray:
        """The most that an object can score for each query that none of `depth` entries of each of its lists has shown."""
        n = len(self.x)
        if depth >= n:
            return np.full(len(signed), -np.inf)
        top, bottom = self.x[self.order[n - 1 - depth], self.at], self.x[self.order[depth], self.at]
        self.made += signed.size
        return signed @ np.concatenate([top, -bottom])

    def shown(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Objects that one of the lists that a query reads has shown up to the depth."""
        upper, lower = self.order[len(self.x) - depth :, q > 0], self.order[:depth, q < 0]
        return np.unique(np.concatenate([upper.ravel(), lower.ravel()]))

    def search(self, q: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, object rows, scores) that may reach the floor of their query."""
        n, active = len(self.x), np.arange(len(q))
        signed = np.hstack([np.maximum(q, 0), np.maximum(-q, 0)])
        for part in DEPTHS:
            depth = int(np.ceil(n * part))
            done = self.threshold(signed[active], depth) < floor[active] - SLACK
            for i in active[done].tolist() if depth else ():
                o = self.shown(q[i], depth)
                self.made += len(o) * q.shape[1]
                yield np.full(len(o), i), o, self.x[o] @ q[i]
            active = active[~done]
            if not len(active):
                return
        self.made += len(active) * self.x.size
        s = q[active] @ self.x.T
        r, o = np.nonzero(s >= (floor[active] - SLACK)[:, None])
        yield active[r], o, s[r, o]


class Best:
    """The k best objects of each query so far: scores fall, and of equals ids rise."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.score, self.found = ids, np.full((len(ids), k), -np.inf), np.full((len(ids), k), _NONE)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, r: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.round(s, 6)
        keep = (ids != self.ids[r]) & (s >= self.floor()[r])
        touched = np.unique(r[keep])
        have_r, have_c = np.nonzero(np.isfinite(self.score[touched]))
        r = np.concatenate([r[keep], touched[have_r]])
        ids = np.concatenate([ids[keep], self.found[touched][have_r, have_c]])
        s = np.concatenate([s[keep], self.score[touched][have_r, have_c]])
        order = np.lexsort((ids, -s, r))
        r, ids, s = r[order], ids[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        self.score[touched], self.found[touched] = -np.inf, _NONE
        self.score[r[top], place[top]], self.found[r[top], place[top]] = s[top], ids[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(np.isfinite(self.score))
        return self.ids[r], self.found[r, c], self.score[r, c]


def _unit(rows: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """(cluster, i, x): unit vectors as bytes, with the number of the pivot that is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            ok = np.flatnonzero(np.isfinite(x).all(axis=1))
            x = np.ascontiguousarray(x[ok])
            near = (x @ pivots.T).argmax(axis=1) if len(pivots) else np.zeros(len(x), np.int64)
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 8 * dim).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), batch.column(0).take(pa.array(ok)), raw], names=["cluster", "i", "x"])

    return rows.mapInArrow(run, "cluster bigint, i bigint, x binary")


def blocks(vectors: DataFrame, scratch: Scratch, dim: int, key: str, vector: str) -> DataFrame:
    """(ids, x, sorted): blocks of unit vectors that are near each other, with their sorted lists."""
    rows = (
        vectors.select(F.col(key).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("i").isNotNull() & F.col("v").isNotNull())
        .where(F.size("v") == dim)
        .where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    )
    if not rows.groupBy("i").count().where("count > 1").isEmpty():  # vectors are shuffled only where an id is repeated
        rows = rows.groupBy("i").agg(F.min("v").alias("v"))
    # PIVOTS bounds what the driver holds
    some = rows.orderBy(F.xxhash64("i"), "i").limit(PIVOTS).toArrow()
    pivots = np.array(some.column("v").to_pylist(), np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        pivots = np.nan_to_num(pivots / np.sqrt(np.einsum("ij,ij->i", pivots, pivots))[:, None], posinf=0, neginf=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = t.column(1).to_numpy()
            x = np.frombuffer(b"".join(t.column(2).to_pylist()), np.float64).reshape(-1, dim)
            for a in range(0, len(ids), BLOCK):
                part = np.ascontiguousarray(x[a : a + BLOCK])
                order = SortedLists(part).order
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids[a : a + BLOCK], part, order)], names=["ids", "x", "sorted"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 8 * BLOCK:
                whole = pa.Table.from_batches(held)
                yield from out(whole.slice(0, n // BLOCK * BLOCK))
                held, n = whole.slice(n // BLOCK * BLOCK).to_batches(), n % BLOCK
        if n:
            yield from out(pa.Table.from_batches(held))

    # a cluster may be any number of rows, so ranges go on by id
    near = _unit(rows, dim, pivots).repartitionByRange("cluster", "i").sortWithinPartitions("cluster", "i")
    return scratch.save(near.mapInArrow(run, "ids binary, x binary, sorted binary"))


def top_k(vectors: DataFrame, scratch: Scratch, k: int = TOP, key: str = "vec_id", vector: str = "embedding", every: int = EVERY) -> DataFrame:
    """(key, rank, neighbour, score): the k rows of greatest cosine for every row whose id is divisible by `every`."""
    dims = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 1
    made = blocks(vectors, scratch, dim, key, vector)
    n = max(1, made.count())
    unpack = lambda raw, kind: np.frombuffer(raw, kind)
    lists_of = lambda x, order: SortedLists(unpack(x, np.float64).reshape(-1, dim), unpack(order, np.int32).reshape(-1, dim))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(qids, qx, score, found): the queries of each block, and what their own block has for them."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = unpack(batch.column(0)[i].as_py(), np.int64), unpack(batch.column(1)[i].as_py(), np.float64).reshape(-1, dim)
                mine = np.flatnonzero(ids % every == 0)
                if not len(mine):
                    continue
                best = Best(ids[mine], k)
                s = x[mine] @ x.T
                best.add(np.repeat(np.arange(len(mine)), len(ids)), np.tile(ids, len(mine)), s.ravel())
                out = (best.ids, np.ascontiguousarray(x[mine]), best.score, best.found)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in out], names=["qids", "qx", "qs", "qf"])

    queries = scratch.save(made.mapInArrow(own, "qids binary, qx binary, qs binary, qf binary")).repartition(max(1, min(n, n // every + 8)))
    objects = made.coalesce(max(1, n // OBJECT_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best, q = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=[key, "neighbour", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                qids, qx, qs, qf, ids, x, order = (c[i].as_py() for c in batch.columns)
                if qids != name:
                    if name is not None:
                        yield done()
                    name, q, best = qids, unpack(qx, np.float64).reshape(-1, dim), Best(unpack(qids, np.int64), k)
                    best.score, best.found = unpack(qs, np.float64).reshape(-1, k).copy(), unpack(qf, np.int64).reshape(-1, k).copy()
                oid = unpack(ids, np.int64)
                if oid.size and np.isin(best.ids, oid).all():
                    continue  # their own block, which they have met
                for r, o, s in lists_of(x, order).search(q, best.floor()):
                    best.add(r, oid[o], s)
        if name is not None:
            yield done()

    found = queries.crossJoin(objects).mapInArrow(run, f"{key} bigint, neighbour bigint, score double")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "neighbour")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "neighbour", "score")
