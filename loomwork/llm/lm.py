"""Language-model scoring: a hierarchical Pitman-Yor model of words over bytes.

A text is a sequence of words (maximal runs of what isn't white space). Every
word is predicted from the word before it: each preceding word is a Chinese
restaurant whose dishes are the words that follow it. All these restaurants
share a parent, which spells words: the probability of a word's bytes and of
the blank that ends it, each byte by the two before it. Contexts of bytes are
restaurants as well, whose parents, shared in turn, are their suffixes, up to
the empty context, whose base is uniform. So the number of restaurants grows
with the corpus, and a word that was never seen has a probability.

Seating is sampled by blocked Gibbs: all customers of a dish in a restaurant
leave and are seated again one after another, given the seating of everyone
else. The predictive probabilities of the sweeps after burn-in are averaged.

A text is no surprise to a model that was made of it, noise least of all. So
the customers that a text itself sent are taken out of the restaurants of
words before its words are predicted (a dish's tables shrink as the discount
has it), and words are spelled by the bytes of the other fold of the corpus (by
a hash of the text). A text that occurs twice still meets its twin.

How it is spread over a cluster: bytes are counted with partial aggregation
(at most 256^3 trigrams a fold, sampled by the driver). The occurrences of
words go to rooms, by the word before them: a task packs what its texts send
to a room into one compressed row, with copies of a text within CHUNK_BYTES
sent once and weighted; nine bytes a word and a half more for what goes with
it, whatever the number of rooms (words are told apart within their restaurant
by 23 bits of a hash, spellings have 16 significant bits); a room samples its restaurants, scores all that it
got, and sends each chunk its sums. The occurrences of a word of more than
ROOM_WORDS are in several rooms, each for a part of the texts (by their hash);
its restaurant is one all the same: in a pass before, the customers of its
dishes are counted over all texts, it is sampled by one task, which holds its
dishes, and each of its rooms is told of the dishes that it has. So a score
doesn't hang on which words are hot, but for the draws of the sampler. Which
are is counted over all texts, but for what a slice has less of than its share
of half a room.

Defined results for odd input: a null text, or an empty one, has 0 bytes, a
log_prob of 0 and a null perplexity; a blank text has no word and a log_prob
of 0; a text without blanks is one word, which is spelled, however long it is;
a doc_id may be null or repeated, each row is scored for itself; equal texts
have equal scores; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Scratch

DISCOUNT, STRENGTH, SWEEPS, BURN_IN, ONE_BY_ONE = 0.7, 1.0, 4, 2, 32
ROOM_BYTES, ROOM_WORDS, CHUNK_BYTES, CHUNK_ROWS, HELD, MAX_TASKS = 4 << 20, 400_000, 8 << 20, 60_000, 1_000_000, 50_000
FOLD, SIZE, CONTEXT = 24, 25, 28  # places, in a key, of the fold, of the number of bytes, and of whether it is a context
BEGIN = K.U64(0x2545F4914F6CDD1D)  # stands before the first word
_HOT = K.U64(1 << 63)
HOT_BIT = K.U64(1 << 24)  # of a restaurant's name in a room: it is one of several rooms


def seat(rng: np.random.Generator, c: np.ndarray, room: np.ndarray, base: np.ndarray, tables: np.ndarray, own: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """New table counts of cells: the c customers of each dish sit down one after another.

    room: the cell's restaurant; base: the parent's probability of the dish;
    tables: all tables of each restaurant; own: the cell's tables before, which
    leave first. Beyond ONE_BY_ONE customers they come in doubling groups, a
    group's new tables drawn from the probabilities at its middle.
    """
    t = np.ones(len(c), dtype=np.int64)
    others = (tables[room] - own).astype(np.float64)
    at = np.flatnonzero(c > 1)
    j, group = 1, 1
    while len(at):
        new = (strength + discount * (others[at] + t[at])) * base[at]
        old = np.maximum(j + (group - 1) / 2 - discount * t[at], 1e-9)
        p = new / (new + old)
        t[at] += rng.random(len(at)) < p if group == 1 else rng.binomial(np.minimum(group, c[at] - j), p)
        j += group
        group = 1 if j < ONE_BY_ONE else j // 2
        at = at[c[at] > j]
    return np.minimum(t, c)


class Level:
    """Restaurants of contexts of one length: their cells (context, dish), sorted."""

    def __init__(self, cells: np.ndarray, length: int):
        self.cells, self.length = cells, length
        ctx = cells >> K.U64(8)
        self.contexts, self.room = np.unique(ctx, return_inverse=True)
        self.c = np.zeros(len(cells), np.int64)
        self.t = np.zeros(len(cells), np.int64)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.contexts)
        return np.bincount(self.room, self.c, m), np.bincount(self.room, self.t, m)

    def kept_for_new(self, d: float, s: float) -> np.ndarray:
        """Mass that each context keeps for dishes it lacks."""
        c, t = self.sums()
        return (s + d * t) / (s + c)

    def predictive(self, base: np.ndarray, d: float, s: float) -> np.ndarray:
        """Probability of each cell's dish, given the parent's of it."""
        c, t = self.sums()
        return (self.c - d * self.t + (s + d * t[self.room]) * base) / (s + c[self.room])

    def reseat(self, rng: np.random.Generator, base: np.ndarray, d: float, s: float) -> None:
        self.t = seat(rng, self.c, self.room, base, self.sums()[1], self.t, d, s)


def build(cells: np.ndarray, counts: np.ndarray, longest: int, shortest: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels from contexts of `longest` bytes to those of `shortest`, and the cell of the parent of each cell."""
    levels, up = [Level(cells, longest)], []
    levels[0].c = counts.astype(np.int64)
    for length in range(longest - 1, shortest - 1, -1):
        key = levels[-1].cells & K.U64((1 << (8 * (length + 1))) - 1)
        cells, parent = np.unique(key, return_inverse=True)
        levels.append(Level(cells, length))
        up.append(parent)
    return levels, up


def predictives(levels: list[Level], up: list[np.ndarray], base: np.ndarray, d: float, s: float) -> list[np.ndarray]:
    """Probability of each cell's dish, by level; base: of the cells of the shortest contexts."""
    out = [levels[-1].predictive(base, d, s)]
    for level, parent in zip(levels[-2::-1], up[::-1], strict=True):
        out.append(level.predictive(out[-1][parent], d, s))
    return out[::-1]


def sample_chain(levels: list[Level], up: list[np.ndarray], base: np.ndarray, sweeps: int, burn_in: int, rng: np.random.Generator, d: float, s: float, sampled: Callable[[], None]) -> None:
    """Gibbs sweeps over the levels, from the longest contexts up; sampled() is called after each one that counts."""
    for k, level in enumerate(levels):  # at first: one table a dish
        if k:
            level.c = np.bincount(up[k - 1], levels[k - 1].t, len(level.cells)).astype(np.int64)
        level.t = np.minimum(level.c, 1)
    for sweep in range(sweeps):
        p = predictives(levels, up, base, d, s)  # a level's parents are as the sweep before left them
        for k, level in enumerate(levels):
            if k:
                level.c = np.bincount(up[k - 1], levels[k - 1].t, len(level.cells)).astype(np.int64)
                level.t = np.minimum(level.t, level.c)
            level.reseat(rng, base if k == len(up) else p[k + 1][up[k]], d, s)
        if sweep >= burn_in:
            sampled()


# words and their spelling


def words(d: np.ndarray, o: np.ndarray) -> tuple[K.Tokens, np.ndarray]:
    t = K.tokens(d, o, K.NONSPACE)
    return t, K.token_hashes(d, t)


def spelling(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, word) of the bytes of words and of the blank after each; before a word there are blanks. The last byte of a trigram is lowest."""
    size = end - start
    at = np.cumsum(size + 3) - (size + 3)
    buf = np.full(int((size + 3).sum()), 32, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    buf[step + np.repeat(at + 2, size)] = d[step + np.repeat(start, size)]
    x = buf.astype(K.U64)
    g = x[2:] | x[1:-1] << K.U64(8) | x[:-2] << K.U64(16)
    word = np.repeat(np.arange(len(size)), size + 1)
    return g[np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - (size + 1) - at, size + 1)], word


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def count(docs: DataFrame, total: int) -> DataFrame:
    """(key, n) over all documents: trigrams of bytes with the fold at bit FOLD, and, as negative keys, words that a slice has its share of half a room of. total: bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            k, n = _merged(keys, counts)
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], names=["key", "n"])

        for batch in batches:
            data, off = K.flat(batch.column(1))
            folds = batch.column(0).to_numpy().view(np.uint64) & K.U64(1)
            for lo, hi, d, o in K.slices(data, off):
                t, h = words(d, o)
                fold = folds[lo:hi][t.doc]
                share = max(2, int(ROOM_WORDS / 2 * len(d) / max(total, 1)))
                w, at, n = np.unique(h, return_index=True, return_counts=True)
                keys.append(w[n >= share] | _HOT)
                counts.append(n[n >= share])
                if hi - lo >= share:
                    keys.append(np.array([BEGIN | _HOT]))
                    counts.append(np.array([hi - lo]))
                w, at, n = np.unique(h ^ fold, return_index=True, return_counts=True)
                if len(w):
                    g, word = spelling(d, t.start[at], t.end[at])
                    g, at_ = np.unique(g | fold[at][word] << K.U64(FOLD), return_inverse=True)
                    keys.append(g)
                    counts.append(np.bincount(at_, n[word], len(g)).astype(np.int64))
                if sum(map(len, keys)) > HELD:
                    k, n = _merged(keys, counts)
                    if len(k) > HELD // 2:
                        yield from out()
                        keys.clear(), counts.clear()
                    else:
                        keys[:], counts[:] = [k], [n]
        if keys:
            yield from out()

    return docs.select(F.xxhash64("text").alias("t1"), "text").where("text is not null").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Speller:
    """Logarithms of the averaged probabilities of trigrams and bigrams of bytes, of the mass that their contexts keep for others, and of single bytes, by fold."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, sweeps: int = SWEEPS + 2, burn_in: int = BURN_IN, seed: int = 5, d: float = DISCOUNT, s: float = STRENGTH):
        keys, values = [np.zeros(0, K.U64)], [np.zeros(0)]
        self.root = np.full((2, 256), -np.log(256))
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        for fold in (0, 1):
            mine = grams >> K.U64(FOLD) == fold
            if not mine.any():
                continue
            levels, up = build(grams[mine] & K.U64(0xFFFFFF), counts[mine], 2, 0)
            base = np.full(len(levels[-1].cells), 1 / 256)
            p = [np.zeros(len(x.cells)) for x in levels]
            new = [np.zeros(len(x.contexts)) for x in levels]

            def sampled() -> None:
                for k, x in enumerate(predictives(levels, up, base, d, s)):  # noqa: B023
                    p[k] += x / (sweeps - burn_in)  # noqa: B023
                    new[k] += levels[k].kept_for_new(d, s) / (sweeps - burn_in)  # noqa: B023

            sample_chain(levels, up, base, sweeps, burn_in, np.random.default_rng(seed + fold), d, s, sampled)
            for k in (0, 1):
                keys += [_keys(levels[k].cells, 3 - k, fold, False), _keys(levels[k].contexts, 3 - k, fold, True)]
                values += [np.log(p[k]), np.log(new[k])]
            self.root[fold] = np.log(new[2][0] / 256)
            self.root[fold][levels[2].cells.astype(np.int64)] = np.log(p[2])
        self.lookup, self.values = K.Lookup(np.concatenate(keys)), np.concatenate(values)

    def log_probs(self, g: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of the last byte of each trigram by the model of the fold; what it lacks is looked for in its parents."""
        find, out, at = self.lookup.table.find, np.zeros(len(g)), np.arange(len(g))
        for n in (3, 2):
            x, f = g[at] & K.U64((1 << (8 * n)) - 1), fold[at]
            row = find(_keys(x, n, f, False))
            hit = row >= 0
            out[at[hit]] += self.values[row[hit]]
            at, x, f = at[~hit], x[~hit], f[~hit]
            row = find(_keys(x >> K.U64(8), n, f, True))
            known = row >= 0
            out[at[known]] += self.values[row[known]]
        out[at] += self.root[fold[at].astype(np.int64), (g[at] & K.U64(255)).astype(np.int64)]
        return out

    def words(self, d: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each word."""
        out = np.zeros(len(start))
        # so many words at once that their bytes are few, but a word is never cut
        parts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(end - start) // (1 << 18))) + 1, [len(start)]])
        for a, b in zip(parts[:-1].tolist(), parts[1:].tolist()):
            if b > a:
                g, word = spelling(d, start[a:b], end[a:b])
                out[a:b] = np.bincount(word, self.log_probs(g, fold[a:b][word]), b - a)
        return out


def _keys(x: np.ndarray, n: int, fold: np.ndarray | int, context: bool) -> np.ndarray:
    return x | np.asarray(fold, K.U64) << K.U64(FOLD) | K.U64(n << SIZE | context << CONTEXT)


# rooms


def packed(*columns: np.ndarray) -> bytes:
    """Unsigned arrays as one compressed piece of bytes, each by its bytes of equal weight."""
    head = np.array([len(columns), *(v for x in columns for v in (x.itemsize, x.size))], np.int64)
    raw = head.tobytes() + b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> list[np.ndarray]:
    whole = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(whole, np.int64, 1)[0])
    head, out, at = np.frombuffer(whole, np.int64, 2 * n, 8), [], 8 + 16 * n
    for width, size in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        planes = np.frombuffer(whole, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel() if size else np.zeros(0, f"<u{width}"))
        at += width * size
    return out


def to_24(x: np.ndarray) -> np.ndarray:
    """Numbers as floats of 24 bits, of 16 significant ones; their highest byte is 0."""
    return (x.astype(np.float32).view(np.uint32).astype(np.uint64) + np.uint64(128) >> np.uint64(8)).astype(np.uint32)


def from_24(x: np.ndarray) -> np.ndarray:
    return (x << np.uint32(8)).view(np.float32).astype(np.float64)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(x, prepend=0).astype(np.uint16)


def chunks(text: pa.Array) -> Iterator[tuple[int, int]]:
    _, off = K.flat(text)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, lo + CHUNK_ROWS, len(text))
        yield lo, hi
        lo = hi


def occurrences(text: pa.Array, t1: np.ndarray, speller: Speller, hot: K.Lookup, rooms: np.ndarray) -> tuple[np.ndarray, ...]:
    """What occurrences_and_hot gives, but for the last."""
    return occurrences_and_hot(text, t1, speller, hot, rooms)[:4]


def occurrences_and_hot(text: pa.Array, t1: np.ndarray, speller: Speller, hot: K.Lookup, rooms: np.ndarray) -> tuple[np.ndarray, ...]:
    """(restaurant, word, logarithm of its spelling, document, number of the hot word before it or -1) of each word of the texts. A restaurant is 64 bits of a hash, of which a room goes by 24; a word is 23 bits of its hash, among the words of its restaurant, and, lowest, one that says which fold spells it."""
    data, off = K.flat(text)
    parts: list[tuple[np.ndarray, ...]] = []
    for lo, hi, d, o in K.slices(data, off):
        t, h = words(d, o)
        if not len(h):
            continue
        doc = t.doc
        fold = (t1[lo:hi][doc] & K.U64(1)) ^ K.U64(1)  # the other one
        _, at, which = np.unique(h ^ fold, return_index=True, return_inverse=True)
        spelled = speller.words(d, t.start[at], t.end[at], fold[at])[which]
        before = np.concatenate([[BEGIN], h[:-1]])
        before[t.first[:-1][np.diff(t.first) > 0]] = BEGIN
        row = hot.table.find(before | _HOT)
        split = np.flatnonzero(row >= 0)
        part = K.mix(t1[lo:hi][doc[split]]) % rooms[row[split]].astype(K.U64)
        before[split] = K.mix(before[split] + part * K.U64(0x9E3779B97F4A7C15))
        parts.append((before, h >> K.U64(41) << K.U64(1) | fold, spelled, doc + lo, row.astype(np.int64)))
    if not parts:
        return np.zeros(0, K.U64), np.zeros(0, K.U64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def texts_once(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, how often each is there, t1, t2) of the distinct texts of (t1, t2, text)."""
    t1, t2 = (part.column(j).to_numpy().view(np.uint64) for j in (0, 1))
    order = np.lexsort((t2, t1))
    first = np.flatnonzero(np.concatenate([[True], (t1[order][1:] != t1[order][:-1]) | (t2[order][1:] != t2[order][:-1])]))
    once = order[first]
    return once, np.diff(np.append(first, len(order))), t1[once], t2[once]


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text").where("text is not null")


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and, last, the number of rows."""
    n = len(columns[0])
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if n else np.zeros(0, bool)
    return np.concatenate([np.zeros(min(n, 1), np.int64), np.flatnonzero(new) + 1, [n]])


def merged_cells(hot: np.ndarray, v: np.ndarray, w: np.ndarray, spelled: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct (hot, v, w) once, sorted, with the sum of n and the greatest of spelled (as floats of 24 bits)."""
    order = np.lexsort((spelled, w, v, hot))
    hot, v, w, spelled, n = (x[order] for x in (hot, v, w, spelled, n))
    first = runs(hot, v, w)[:-1]
    # logarithms are below 0: the least bits are the greatest
    return hot[first], v[first], w[first], spelled[first], np.add.reduceat(n, first) if len(first) else n


def hot_parts(docs: DataFrame, speller: Speller, hot: K.Lookup, rooms: np.ndarray, n_rooms: int) -> DataFrame:
    """(hot, room, cells): of each room that a hot word has, the dishes and their customers: packed names of the restaurant in the room (one), words, spellings, counts."""
    shared = docs.sparkSession.sparkContext.broadcast((speller, hot, rooms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                once, weight, t1, _ = texts_once(part)
                before, word, spelled, doc, row = occurrences_and_hot(part.column(2).take(pa.array(once)), t1, *shared.value)
                mine = np.flatnonzero(row >= 0)
                room = ((before[mine] >> K.U64(16)) % K.U64(n_rooms)).astype(np.int64)
                v = (before[mine] >> K.U64(40) | HOT_BIT).astype(np.int64)
                # the room leads, above the number of the hot word
                key, v, w, sp, n = merged_cells(room << 32 | row[mine], v, word[mine].astype(np.int64), to_24(spelled[mine]), weight[doc[mine]].astype(np.int64))
                edges = runs(key >> 32)
                out = [packed(*(x[a:b].astype(np.uint32) for x in (key & 0xFFFFFFFF, v, w, sp, n))) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[edges[:-1]] >> 32), pa.array(out, pa.binary())], names=["room", "cells"])

    def of_room(room: int, raws: list[bytes]) -> pa.RecordBatch:
        row, v, w, sp, n = merged_cells(*(np.concatenate(x).astype(np.int64) for x in zip(*map(unpacked, raws), strict=True)))
        edges = runs(row, v)
        out = [packed(v[a : a + 1].astype(np.uint32), w[a:b].astype(np.uint32), sp[a:b].astype(np.uint32), n[a:b].astype(np.uint32)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(row[edges[:-1]]), pa.array(np.full(len(out), room)), pa.array(out, pa.binary())], names=["hot", "room", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = None
        for batch in batches:
            for room, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and room != current:
                    yield of_room(current, held)
                    held = []
                current = room
                held.append(raw)
        if held:
            yield of_room(current, held)

    sent = keyed_texts(docs).mapInArrow(run, "room bigint, cells binary")
    return sent.repartition(room_tasks(docs, n_rooms), "room").sortWithinPartitions("room").mapInArrow(merge, "hot bigint, room bigint, cells binary")


def hot_seats(parts: DataFrame, words: np.ndarray, seed: int = 7, sweeps: int = SWEEPS, burn_in: int = BURN_IN, d: float = DISCOUNT, s: float = STRENGTH) -> DataFrame:
    """(room, known) of hot_parts: what each room is told: packed name of the restaurant, words, their customers, customers of the restaurant, and, of each sweep that counts, tables of the words, and of the restaurant. words: the hot ones, which seed the draws. A restaurant's dishes are held by its task, its parts come twice, to be counted and to be told."""

    def sampled(w: np.ndarray, spelled: np.ndarray, c: np.ndarray, hot: int) -> list[np.ndarray]:
        base, zero, t, out = np.exp(from_24(spelled.astype(np.uint32))), np.zeros(len(w), np.int64), np.minimum(c, 1), []
        rng = np.random.default_rng([seed, int(words[hot])])
        for sweep in range(sweeps):
            t = seat(rng, c, zero, base, np.array([t.sum()]), t, d, s)
            if sweep >= burn_in:
                out.append(t)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros(0, np.int64)
        current, cells, more, seats = None, (z, z, z), [], []

        def merge() -> tuple[np.ndarray, ...]:
            w, sp, n = (np.concatenate(x) for x in zip(cells, *more, strict=True))
            more.clear()
            same = np.zeros(len(w), np.int64)
            return merged_cells(same, same, w, sp, n)[2:]

        for batch in batches:
            for hot, again, room, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot != current:
                    current, cells, seats = hot, (z, z, z), []
                v, w, sp, n = (x.astype(np.int64) for x in unpacked(raw))
                if not again:
                    more.append((w, sp, n))
                    if sum(len(x[0]) for x in more) > max(HELD, len(cells[0])):
                        cells = merge()
                    continue
                if not seats:
                    # spelled as in a room of its own: by the first fold that it is in
                    w_all, sp, n = merge()
                    first = runs(w_all | 1)[:-1]
                    cells = (w_all[first] | 1, sp[first], np.add.reduceat(n, first))
                    seats = sampled(*cells, hot)
                w = np.unique(w | 1)
                at = np.searchsorted(cells[0], w)
                told = [w.astype(np.uint32), cells[2][at].astype(np.uint64), np.array([cells[2].sum()], np.uint64)]
                for t in seats:
                    told += [t[at].astype(np.uint64), np.array([t.sum()], np.uint64)]
                yield pa.RecordBatch.from_arrays([pa.array([room]), pa.array([packed(v.astype(np.uint32), *told)], pa.binary())], names=["room", "known"])

    twice = parts.select("hot", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"), "room", "cells")
    return twice.repartition("hot").sortWithinPartitions("hot", "again", "room").mapInArrow(run, "room bigint, known binary")


def send(docs: DataFrame, speller: Speller, hot: K.Lookup, rooms: np.ndarray, n_rooms: int) -> DataFrame:
    """(room, chunk, sent, keys): the occurrences that a chunk of texts sends to a room; keys, in one row of each chunk, are the hashes of its texts."""
    shared = docs.sparkSession.sparkContext.broadcast((speller, hot, rooms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                once, weight, *keys = texts_once(part)
                keys = np.concatenate(keys)
                name = int(K.span_hash(K.prefix_hash(keys), np.array([0]), np.array([len(keys)])).view(np.int64)[0])
                before, word, spelled, doc, row = occurrences_and_hot(part.column(2).take(pa.array(once)), keys[: len(once)], *shared.value)
                room = (before >> K.U64(16)) % K.U64(n_rooms)
                by = np.argsort(room.astype(np.uint16) if n_rooms < 1 << 16 else room, kind="stable")
                before, word, spelled, doc, room = before[by] >> K.U64(40) | np.where(row[by] >= 0, HOT_BIT, K.U64(0)), word[by], spelled[by], doc[by], room[by]
                edges = np.flatnonzero(np.concatenate([[True], room[1:] != room[:-1]])) if len(room) else np.zeros(1, np.int64)
                out: list[list] = [[], [], [], []]
                for k, (a, b) in enumerate(zip(edges.tolist(), [*edges[1:].tolist(), len(room)])):
                    # documents ascend
                    mine = doc[a:b]
                    dd = mine[np.concatenate([[True], mine[1:] != mine[:-1]])] if b > a else mine
                    v, w = (x[a:b].astype(np.uint32) for x in (before, word))
                    sent = packed(v, w, to_24(spelled[a:b]), steps(mine), weight[dd].astype(np.uint32))
                    for col, x in zip(out, (int(room[a]) if b > a else 0, name, sent, keys.tobytes() if not k else None), strict=True):
                        col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["room", "chunk", "sent", "keys"])

    return keyed_texts(docs).mapInArrow(run, "room bigint, chunk bigint, sent binary, keys binary")


def score_room(before: np.ndarray, word: np.ndarray, spelled: np.ndarray, doc: np.ndarray, weight: np.ndarray, seed: int, sweeps: int = SWEEPS, burn_in: int = BURN_IN, d: float = DISCOUNT, s: float = STRENGTH, known: list[list[np.ndarray]] | None = None) -> np.ndarray:
    """For each document, the logarithm of the probability of its words here, predicted without what it sent itself; weight: how often the document is there; known: of restaurants of several rooms, what hot_seats tells."""
    order = np.lexsort((doc, word, before))
    before, word, spelled, doc = before[order], word[order] | K.U64(1), spelled[order].astype(np.float64), doc[order]
    turn = lambda *x: np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in x])])
    new_cell, new_room = turn(before, word), turn(before)
    # a group: what a document sent to a dish (by one fold, since a document is in one)
    group = np.flatnonzero(turn(before, word, spelled, doc))
    own = np.diff(np.append(group, len(doc)))
    cell, room = (np.cumsum(new_cell) - 1)[group], np.cumsum(new_room) - 1
    room_of_cell, base = room[new_cell], np.exp(spelled[new_cell])
    room, doc, spelled = room[group], doc[group], spelled[group]
    n_cells, n_rooms = int(cell[-1]) + 1, int(room[-1]) + 1
    c = np.bincount(cell, own * weight[doc], n_cells).astype(np.int64)
    _, pair = np.unique(doc.astype(np.int64) * n_rooms + room, return_inverse=True)
    customers, theirs = np.bincount(room_of_cell, c, n_rooms), []
    for v, w, n, n_all, *seats in known or []:
        r = int(np.searchsorted(before[new_room], K.U64(v[0])))
        mine = np.flatnonzero(room_of_cell == r)
        at = np.searchsorted(w, word[new_cell][mine])
        c[mine], customers[r] = n[at], n_all[0]
        theirs.append((r, mine, [x[at].astype(np.int64) for x in seats[::2]], [int(x[0]) for x in seats[1::2]]))
    left = c[cell] - own
    present = customers[room] - np.bincount(pair, own)[pair]
    t, rng = np.minimum(c, 1), np.random.default_rng(seed)
    old, new = np.zeros(len(group)), np.zeros(len(group))
    for sweep in range(sweeps):
        tables = np.bincount(room_of_cell, t, n_rooms)
        t = seat(rng, c, room_of_cell, base, tables, t, d, s)
        if sweep < burn_in:
            continue
        everyone = np.bincount(room_of_cell, t, n_rooms)
        for r, mine, seats, n_all in theirs:
            t[mine], everyone[r] = seats[sweep - burn_in], n_all[sweep - burn_in]
        # a dish's tables follow its customers to the power of the discount
        t_left = np.where(left > 0, np.clip(t[cell] * (left / c[cell]) ** d, 1, np.maximum(left, 1)), 0.0)
        tables = everyone[room] - np.bincount(pair, t[cell] - t_left)[pair]
        old += (left - d * t_left) / (s + present)
        new += (s + d * tables) / (s + present)
    with np.errstate(divide="ignore"):
        lp = np.logaddexp(np.log(old), np.log(new) + spelled) - np.log(sweeps - burn_in)
    return np.bincount(doc, own * lp, len(weight))


def room_tasks(df: DataFrame, n_rooms: int) -> int:
    return min(MAX_TASKS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rooms // 2))


def in_rooms(sent: DataFrame, n_rooms: int, seed: int = 5) -> DataFrame:
    """(chunk, got, keys): what each room says of the documents of a chunk. A null chunk: what a room is told by hot_seats."""

    def of_room(room: int, rows: list[tuple[int | None, bytes, bytes | None]]) -> pa.RecordBatch:
        known = [unpacked(r[1]) for r in rows if r[0] is None]
        rows = [r for r in rows if r[0] is not None]
        columns: list[list[np.ndarray]] = [[], [], [], []]
        names, weights, at = [], [], 0
        for _, raw, _ in rows:
            v, w, spelled, step, weight = unpacked(raw)
            doc = np.cumsum(step.astype(np.int64))
            dd, d_at = np.unique(doc, return_inverse=True)
            for column, x in zip(columns, (v.astype(K.U64), w.astype(K.U64), from_24(spelled), d_at + at), strict=True):
                column.append(x)
            names.append(dd)
            weights.append(weight)
            at += len(dd)
        lp = score_room(*(np.concatenate(c) for c in columns), np.concatenate(weights), seed + room, known=known) if at else np.zeros(0)
        out, at = [], 0
        for dd in names:
            out.append(packed(steps(dd), to_24(lp[at : at + len(dd)])))
            at += len(dd)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(out, pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "got", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes | None]] = []
        current = None
        for batch in batches:
            for room, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and room != current:
                    yield of_room(current, held)
                    held = []
                current = room
                held.append(tuple(row))
        if held:
            yield of_room(current, held)

    return sent.repartition(room_tasks(sent, n_rooms), "room").sortWithinPartitions("room", "chunk").mapInArrow(run, "chunk bigint, got binary, keys binary")

def by_text(got: DataFrame) -> DataFrame:
    """(t1, t2, log_prob) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, times, sums = None, None, 0, np.zeros(0)

        def done() -> pa.RecordBatch:
            # a chunk that is there several times has been scored as often
            m = len(keys) // 2
            lp = np.zeros(m)
            lp[: len(sums)] = sums[:m] / times
            return pa.RecordBatch.from_arrays([pa.array(keys[:m].view(np.int64)), pa.array(keys[m:].view(np.int64)), pa.array(lp)], names=["t1", "t2", "log_prob"])

        for batch in batches:
            for chunk, raw, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != current:
                    if current is not None:
                        yield done()
                    current, keys, times, sums = chunk, None, 0, np.zeros(CHUNK_ROWS)
                step, lp = unpacked(raw)
                sums[np.cumsum(step.astype(np.int64))] += from_24(lp)
                if named is not None:
                    keys, times = np.frombuffer(named, np.uint64), times + 1
        if current is not None:
            yield done()

    each = got.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "t1 bigint, t2 bigint, log_prob double")
    return each.groupBy("t1", "t2").agg(F.min("log_prob").alias("log_prob"))


def score(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, log_prob, perplexity) of every row by the model of all of them; log_prob is natural, perplexity is per byte."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = scratch.save(count(docs, total))
    grams = counted.where("key >= 0").toArrow()  # at most 2 x 256^3 rows
    speller = Speller(grams.column("key").to_numpy().view(np.uint64), grams.column("n").to_numpy())
    many = counted.where((F.col("key") < 0) & (F.col("n") >= ROOM_WORDS // 2)).toArrow()  # fewer than there are rooms
    hot, rooms = many.column("key").to_numpy().view(np.uint64), -(-2 * many.column("n").to_numpy() // ROOM_WORDS)
    n_rooms = max(1, total // ROOM_BYTES)
    sent = send(docs, speller, K.Lookup(hot), rooms, n_rooms)
    if len(hot):
        parts = scratch.save(hot_parts(docs, speller, K.Lookup(hot), rooms, n_rooms))
        known = hot_seats(parts, hot).select("room", F.lit(None).cast("bigint").alias("chunk"), F.col("known").alias("sent"), F.lit(None).cast("binary").alias("keys"))
        sent = sent.unionByName(known)
    sums = by_text(in_rooms(sent, n_rooms))
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.xxhash64("text").alias("t1"),
        F.xxhash64(F.lit(7), "text").alias("t2"),
    )
    lp = F.coalesce("log_prob", F.lit(0.0))
    return keyed.join(sums, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.round(lp, 4).alias("log_prob"), F.round(F.exp(-lp / F.nullif(F.col("n_bytes"), F.lit(0))), 6).alias("perplexity")
    )
