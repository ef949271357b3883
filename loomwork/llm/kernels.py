"""Vectorised text kernels over Arrow string arrays.

Every kernel works on the flat UTF-8 buffer of a whole batch at once: token
boundaries, token hashes and shingles come out of a handful of numpy passes,
with no Python-level loop over documents or tokens.  Batches are cut into
slices of bounded size at document boundaries, so memory does not follow the
batch; a document longer than a slice is a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 21
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every bit depends on every bit."""
    y = x >> U64(33)
    x = np.bitwise_xor(x, y, out=y)
    x *= U64(0xFF51AFD7ED558CCD)
    y = x >> U64(33)
    x ^= y
    x *= U64(0xC4CEB9FE1A85EC53)
    np.right_shift(x, U64(33), out=y)
    x ^= y
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _R), ("down", _R_INV)):
            steps = np.full(size, U64(base), dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums, of bytes or of hashes, from which span_hash takes the hash of any span."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def sum_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash of ascending spans, from each byte's value, its number and one; what follows a span up to the next one must be of value 0."""
    up, down = _powers(len(values) + 1)
    return mix(np.add.reduceat(values * up[:-1], start) * down[start] + (end - start).astype(U64))


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    _, offsets, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Tokens:
    """Tokens of a slice. first[d]:first[d + 1] are the tokens of its document d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def tokens(data: np.ndarray, off: np.ndarray, table: np.ndarray = LETTERS, inside: np.ndarray | None = None) -> Tokens:
    """Maximal runs of bytes of the table, or of those that are marked, never across documents."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Tokens(z, z, np.zeros(len(off), np.int64))
    inside = table.take(data) if inside is None else inside
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = off[(off > 0) & (off < n)]
    begins[cuts] = inside[cuts]
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    ends[cuts] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    return Tokens(start, np.flatnonzero(ends), np.searchsorted(start, off))


def token_hashes(data: np.ndarray, t: Tokens) -> np.ndarray:
    return span_hash(prefix_hash(data), t.start, t.end)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k tokens. A document of fewer than k tokens, but at least one, has one shingle: all its tokens."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    begin = np.cumsum(count) - count
    at = np.arange(len(doc)) - begin[doc] + first[:-1][doc]
    acc = h[at] * U64(0x9E3779B97F4A7C15)
    last = first[1:][doc] - 1
    short = n < k
    for j in range(1, k):
        nxt = h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else h
        if short.any():
            nxt = np.where(at + j <= last, nxt, U64(0))
        acc = (acc + nxt) * U64(0xD1342543DE82EF95 + 2 * j)
        acc ^= acc >> U64(29)
    return mix(acc), doc


EMPTY = np.uint32(0xFFFFFFFF)


def densify(sig: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin takes the value of a bin drawn by a 2-universal hash of (bin, attempt), drawing again until a full one comes up. Rows without any value stay empty."""
    rows, k = sig.shape
    out = sig.copy()
    empty = sig == EMPTY
    alive = ~empty.all(axis=1)
    r, b = np.nonzero(empty & alive[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        x = mix(b.astype(U64) * U64(0x632BE59BD9B4E019) + U64(attempt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        j = ((x >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
        val = sig[r, j]
        ok = val != EMPTY
        out[r[ok], b[ok]] = val[ok]
        r, b = r[~ok], b[~ok]
    return out


def one_permutation(h: np.ndarray, doc: np.ndarray, rows: int, k: int) -> np.ndarray:
    """One-permutation MinHash: the high half of a hash picks one of k bins, the low half competes in it; then densify."""
    sig = np.full(rows * k, EMPTY, dtype=np.uint32)
    fill_bins(sig, h, doc * k, k)
    return densify(sig.reshape(rows, k))


def fill_bins(sig: np.ndarray, h: np.ndarray, first: np.ndarray, k: int) -> None:
    """Lets hashes compete in the k bins of sig that begin at the place `first` of each."""
    at = np.multiply(h >> U64(32), U64(k))
    at >>= U64(32)
    at = at.view(np.int64)
    at += first
    val = h.astype(np.uint32)
    val[val == EMPTY] = EMPTY - np.uint32(1)
    np.minimum.at(sig, at, val)


def band_keys(sig: np.ndarray, bands: int, width: int) -> np.ndarray:
    """rows x bands: a 64-bit key of each band of `width` signature values."""
    s = sig[:, : bands * width].reshape(len(sig), bands, width).astype(U64)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0xA24BAED4963EE407), s.shape[:2]).copy()
    for j in range(width):
        acc = mix(acc + s[:, :, j] * U64(0x9E3779B97F4A7C15) + U64(j))
    return acc


class HashTable:
    """uint64 keys to row numbers by open addressing, with vectorised lookups."""

    def __init__(self, keys: np.ndarray):
        self.n = 0
        self._room(len(keys))
        self.extend(keys)

    def _room(self, n: int) -> None:
        self.bits = max(4, int(2 * max(1, n) - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=U64)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)

    def extend(self, keys: np.ndarray) -> None:
        """Adds keys that aren't there; their rows follow those that are."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            used = self.rows >= 0
            old = np.zeros(self.n, U64)
            old[self.rows[used]] = self.keys[used]
            self._room(2 * (self.n + len(keys)))
            self.n, keys = 0, np.concatenate([old, keys])
        mine, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(mine):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = mine[free] + self.n
            # a slot's key and row must come from the same writer
            won = self.rows[slot] == mine + self.n
            self.keys[slot[won]] = keys[mine[won]]
            mine, slot = mine[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
        self.n += len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for absent keys."""
        slot = self._slot(q)
        out = self.rows[slot]
        bad = np.flatnonzero((self.keys[slot] != q) & (out >= 0))
        mask = (1 << self.bits) - 1
        at = slot[bad]
        while len(bad):
            at = (at + 1) & mask
            got = self.rows[at]
            hit = (got < 0) | (self.keys[at] == q[bad])
            out[bad[hit]] = got[hit]
            bad, at = bad[~hit], at[~hit]
        return out


class Lookup:
    """Keys to broadcast, whose table each Python worker makes once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self._table = keys, None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "_table": None}

    @property
    def table(self) -> HashTable:
        if self._table is None:
            self._table = HashTable(self.keys)
        return self._table


def lower(arr: pa.Array) -> pa.Array:
    """In small letters; texts that aren't UTF-8, in ASCII's alone."""
    try:
        return pc.utf8_lower(arr)
    except pa.ArrowInvalid:
        return pc.ascii_lower(arr)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(data: bytes, start: np.ndarray, end: np.ndarray) -> list[str]:
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
