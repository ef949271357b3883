"""Byte-level BPE encoding and decoding by replaying the merges over a corpus.

The texts of a chunk are cut into words as the vocabulary's pattern says; the
distinct words are laid out in one array of symbols; an inverted index from
each adjacent pair to its positions takes every merge, in order of rank, to
exactly the places where it applies, and only the neighbours of a place that
was merged are indexed anew. So a merge costs what it touches, over all words
at once, and a word that is frequent is merged once. A chunk is what a task
holds at a time (CHUNK_BYTES of whole documents), and a Python worker keeps
the words of the chunks it has seen, so that "the" is merged once a worker,
not once a chunk. Words don't depend on each other, so this gives the tokens
of one replay over the whole corpus, without a shuffle.

Defined results for odd input: a null text has null tokens; an empty one has
none; a very long text or word is encoded whole; bytes that aren't UTF-8 stay
what they are; doc_id may be null or repeated, each row is for itself; an
empty table gives an empty result; other columns are ignored. Special tokens
in a text are ordinary text. Two pairs never have the same rank, so there are
no ties.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CHUNK_BYTES, MAX_KNOWN = 8 << 20, 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
# what \s matches, as a class of its own
_SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = _LETTER
        elif k == "N":
            out[c] = _NUMBER
    out[[c for c in _SPACES if c not in range(28, 32)]] = _SPACE
    return out


class Vocabulary:
    """Merges in order of rank, the symbol of each byte, and the bytes of each token."""

    def __init__(self, path: str = TOKENIZER):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        ids = model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        byte = {c: b for b, c in shown.items()}
        self.byte_id = np.array([ids[shown[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.new = np.array([ids[a + b] for a, b in pairs], np.int32)
        size = max(ids.values()) + 1
        spelled: list[bytes] = [b""] * size
        for s, i in ids.items():
            spelled[i] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.kinds = classes()
        self._table: K.HashTable | None = None
        self.known: Known | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None, "known": None}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols, -1 where there is none."""
        if self._table is None:
            self._table = K.HashTable(self.left.astype(K.U64) << K.U64(32) | self.right.astype(K.U64))
        return self._table.find(a.astype(K.U64) << K.U64(32) | b.astype(K.U64))

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        size = np.diff(self.spelled_at)[tokens]
        return self.spelled[np.arange(size.sum()) + np.repeat(self.spelled_at[tokens] - (np.cumsum(size) - size), size)]


def words(d: np.ndarray, o: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte offsets where words begin: contractions, runs of letters, of numbers, of others (each with a blank before it), and of white space, as the byte-level pattern has them."""
    # a byte that isn't UTF-8 is a character of its own
    cp = np.frombuffer(d.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    size[(cp >= 0xDC80) & (cp <= 0xDCFF)] = 1
    at = np.cumsum(size) - size
    kind, n = kinds[cp], len(cp)
    doc = np.zeros(n + 1, bool)  # first character of a document
    doc[np.searchsorted(at, o)] = True
    doc[0] = True
    edge = doc[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    cut = edge.copy()
    # the last white space of a run goes with what follows, if it is a blank, and else stands alone
    follows = np.zeros(n, bool)
    follows[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~doc[1:n]
    cut |= follows
    joined = np.zeros(n, bool)
    joined[1:] = follows[:-1] & (cp[:-1] == 32)
    cut &= ~joined
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a word by itself
    q = np.flatnonzero((cp == 39) & cut)
    if len(q):
        q = q[q + 1 < n]
        q = q[(kind[q + 1] == _LETTER) & ~doc[q + 1]]
        c1 = cp[q + 1]
        inside = (q + 2 < n) & ~doc[np.minimum(q + 2, n)]
        c2 = np.where(inside, cp[np.minimum(q + 2, n - 1)], 0)
        two = ((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)
        one = np.isin(c1, [115, 116, 109, 100])
        cut[q[one | two] + 1] = False
        ends = np.concatenate([q[one] + 2, q[two] + 3])
        ends = ends[ends < n]
        cut[ends] = True
    return at[cut]


def replay(symbols: np.ndarray, first: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first token of each word): all merges over words laid out in one array; first[w]:first[w + 1] is word w."""
    n = len(symbols)
    sym = symbols.astype(np.int32).copy()
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[first[1:][np.diff(first) > 0] - 1] = -1
    prv[first[:-1][np.diff(first) > 0]] = -1
    alive = np.ones(n, bool)
    left = np.flatnonzero(nxt >= 0)
    rank = v.ranks(sym[left], sym[nxt[left]])
    left, rank = left[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    left, rank = left[order], rank[order]
    at = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, np.int64)
    index: dict[int, list] = defaultdict(list)
    for r, part in zip(rank[at].tolist(), np.split(left, at[1:]) if len(at) else [], strict=True):
        index[r].append(part)
    late: dict[int, list[int]] = defaultdict(list)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r, [])
        if r in late:
            parts.append(np.array(late.pop(r), np.int64))
        p = np.concatenate(parts) if len(parts) > 1 else parts[0]
        a, b = v.left[r], v.right[r]
        q = nxt[p]
        p = p[alive[p] & (sym[p] == a) & (q >= 0) & (sym[q] == b)]
        if not len(p):
            continue
        if a == b:  # aaa: from the left, without overlaps
            p = np.unique(p)
            chained = np.concatenate([[False], nxt[p[:-1]] == p[1:]])
            i = np.arange(len(p))
            start = np.maximum.accumulate(np.where(chained, 0, i))
            p = p[(i - start) % 2 == 0]
        elif len(parts) > 1:
            p = np.unique(p)
        q = nxt[p]
        after = nxt[q]
        sym[p] = v.new[r]
        alive[q] = False
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        pairs = np.concatenate([before[before >= 0], p[has]])
        if len(pairs):
            k = v.ranks(sym[pairs], sym[nxt[pairs]])
            ok = k >= 0
            for rr, pos in zip(k[ok].tolist(), pairs[ok].tolist(), strict=True):
                if rr not in late and rr not in index:
                    heapq.heappush(heap, rr)
                late[rr].append(pos)
    return sym[alive], np.concatenate([[0], np.cumsum(alive)])[first]


class Known:
    """Words that were merged already, with their tokens; when there are MAX_KNOWN, they are forgotten."""

    def __init__(self) -> None:
        self.table = K.HashTable(np.zeros(0, K.U64))
        self.tokens, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def add(self, hashes: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> None:
        n, end = self.table.n, int(self.at[self.table.n])
        while len(self.tokens) < end + len(tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        while len(self.at) < n + len(first):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.tokens[end : end + len(tokens)] = tokens
        self.at[n + 1 : n + len(first)] = end + first[1:]
        self.table.extend(hashes)


def known_words(d: np.ndarray, o: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(where words begin, the row of each in v.known), after the merges of those that are new."""
    starts, hashes = [], []
    for lo, hi, part, off in K.slices(d, o):
        if len(part):
            s = words(part, off, v.kinds)
            hashes.append(K.span_hash(K.prefix_hash(part), s, np.append(s[1:], len(part))))
            starts.append(s + o[lo])
    start, h = np.concatenate(starts), np.concatenate(hashes)
    if v.known is None or v.known.table.n > MAX_KNOWN:
        v.known = Known()
    row = v.known.table.find(h)
    new = np.flatnonzero(row < 0)
    if len(new):
        fresh, one = np.unique(h[new], return_index=True)
        one = new[one]
        n = np.diff(np.append(start, len(d)))[one]
        first = np.concatenate([[0], np.cumsum(n)])
        laid = d[np.arange(first[-1]) + np.repeat(start[one] - first[:-1], n)]
        v.known.add(fresh, *replay(v.byte_id[laid], first, v))
        row[new] = v.known.table.find(h[new])
    return start, row


def encode_chunk(d: np.ndarray, o: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first token of each document)."""
    if not len(d):
        return np.zeros(0, np.int32), np.zeros(len(o), np.int64)
    start, row = known_words(d, o, v)
    at = v.known.at
    m = at[row + 1] - at[row]
    ends = np.cumsum(m)
    out = v.known.tokens[np.arange(ends[-1]) + np.repeat(at[row] - (ends - m), m)]
    return out, np.concatenate([[0], ends])[np.searchsorted(start, o)]


def counts(data: np.ndarray, off: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Number of tokens of each text."""
    out, lo, rows = [np.zeros(0, np.int64)], 0, len(off) - 1
    while lo < rows:
        hi = min(rows, max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1))
        d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if len(d):
            start, row = known_words(d, o, v)
            n = np.concatenate([[0], np.cumsum(v.known.at[row + 1] - v.known.at[row])])
            out.append(np.diff(n[np.searchsorted(start, o)]))
        else:
            out.append(np.zeros(hi - lo, np.int64))
        lo = hi
    return np.concatenate(out)


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip); round_trip says that decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            data, off = K.flat(batch.column(1))
            lo, rows = 0, len(off) - 1
            while lo < rows:
                hi = min(rows, max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1))
                d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                tok, at = encode_chunk(d, o, v)
                back = v.decode(tok)
                spelled = np.concatenate([[0], np.cumsum(np.diff(v.spelled_at)[tok])])[at]
                wrong = np.concatenate([[0], np.cumsum(back != d)]) if len(back) == len(d) else np.arange(len(d) + 1)
                good = (spelled == o)[1:] & (spelled == o)[:-1] & (np.diff(wrong[o]) == 0)
                null = np.asarray(batch.column(1).slice(lo, hi - lo).is_null())
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tok))
                if null.any():
                    lists = pa.array(lists.to_pylist(), pa.list_(pa.int32()), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), mask=null), lists, pa.array(good, mask=null)],
                    names=["doc_id", "n_tokens", "tokens", "round_trip"],
                )
                lo = hi

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, tokens array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            lists = batch.column(1)
            raw = v.decode(lists.flatten().to_numpy().astype(np.int64)).tobytes()
            size = np.concatenate([[0], np.cumsum(np.diff(v.spelled_at)[lists.flatten().to_numpy()])])
            counts = np.array([0 if x is None else len(x) for x in lists.to_pylist()], np.int64)
            at = size[np.concatenate([[0], np.cumsum(counts)])].tolist()
            null = lists.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if z else raw[a:b].decode("utf-8", "replace") for a, b, z in zip(at, at[1:], null)], pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")
