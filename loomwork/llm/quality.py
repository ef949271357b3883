"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of PASSAGE tokens. Every passage is encoded
(the embeddings of its words and of their beginnings of STEMS bytes, those that
are in the vocabulary, and shape features),
gated attention weighs the passages, and a linear head scores the weighted
passage representation. There are two heads over one encoder, each with an
attention of its own: quality and toxicity. Only document labels are used, so
attention has to find the few passages that make a document toxic.

Training takes at most `sample_rows` labelled documents (the documented
bound), chosen by a hash of doc_id, in one task, so that the driver holds
nothing but the model; scoring covers every document whole, on the executors,
and no other text is shuffled.

Defined results for odd input: a null, empty or blank text has no passage,
scores null and is kept (nothing says that it is bad); a very long
text has as many passages as it needs; a doc_id may be null or repeated, each
row is scored for itself; of several labels of a doc_id the greatest counts;
labels that are null, or of documents that don't exist, are ignored; with
fewer than two classes of a label, its head is constant and rejects nothing; a
score that is just the threshold is kept; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PASSAGE, DIM, GATE, SAMPLE_ROWS, MIN_DOCS, EPOCHS = 32, 16, 8, 5000, 6, 8
N_SHAPES, STEMS = 8, (4, 6)
RATE, START, DECAY, DROP = 0.04, 0.01, 1e-3, 0.5
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Bags:
    """Passages of documents: word hashes by passage, shape features, and where each document's passages begin."""

    word: np.ndarray
    word_at: np.ndarray
    shape: np.ndarray
    first: np.ndarray


def bags(data: np.ndarray, off: np.ndarray, size: int = PASSAGE) -> Bags:
    t = K.tokens(data, off, K.NONSPACE)
    n_tok = np.diff(t.first)
    n_pass = -(-n_tok // size)
    first = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(first[-1])
    if not total:
        z = np.zeros(0, np.int64)
        return Bags(z.astype(K.U64), z, np.zeros((0, N_SHAPES), np.float32), first)
    doc = t.doc
    begins = np.repeat(t.first[:-1], n_pass) + (np.arange(total) - np.repeat(first[:-1], n_pass)) * size
    passage = np.repeat(np.arange(total), np.diff(np.append(begins, len(t.start))))
    width = (t.end - t.start).astype(np.float32)
    sums = lambda table: np.concatenate([[0], np.cumsum(table[data])])
    per = lambda c: (c[t.end] - c[t.start]).astype(np.float32)
    upper, digit, punct = per(sums(_UPPER)), per(sums(_DIGIT)), per(sums(_PUNCT))
    raw = K.span_hash(K.prefix_hash(data), t.start, t.end)
    again = np.zeros(len(raw), np.float32)
    again[1:] = (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1])
    columns = [upper / width > 0.6, upper / width, digit / width, punct / width, punct >= 2, (width == 1) & (punct == 1), again, np.minimum(width, 40) / 20]
    n = np.diff(np.append(begins, len(raw))).astype(np.float32)
    shape = np.stack([np.add.reduceat(c.astype(np.float32), begins) / n for c in columns], axis=1)
    # words: letters only, ASCII case folded
    folded = _FOLD[data]
    w = K.tokens(data, off, K.LETTERS)
    sums, size = K.prefix_hash(folded), w.end - w.start
    # a word, and its beginnings, so that what is known of a stem holds for words that were never seen
    terms = np.stack([K.span_hash(sums, w.start, w.end), *(K.span_hash(sums, w.start, np.minimum(w.start + n, w.end)) ^ K.U64(n) for n in STEMS)], axis=1)
    told = np.stack([np.ones(len(size), bool), *(size > n for n in STEMS)], axis=1)
    at = passage[np.minimum(np.searchsorted(t.end, w.start, "right"), len(passage) - 1)]
    return Bags(terms[told], np.repeat(at, told.sum(axis=1)), shape, first)


class Model:
    """Parameters, and the forward and backward passes in numpy."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = np.sort(vocabulary)
        g = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"E": g(len(vocabulary), DIM, scale=START), "S": g(N_SHAPES, DIM), "b": np.zeros(DIM, np.float32)}
        for h in "qt":
            self.p |= {f"V{h}": g(DIM, GATE), f"U{h}": g(DIM, GATE), f"w{h}": g(GATE), f"c{h}": g(DIM), f"d{h}": np.zeros(1, np.float32)}
        self.constant: dict[str, float | None] = {"q": None, "t": None}
        self._table: K.HashTable | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def rows(self, words: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = K.HashTable(self.vocabulary)
        return self._table.find(words)

    def encode(self, row: np.ndarray, at: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """tanh of the summed embeddings and shapes of each passage; `at` ascends."""
        pre = shape @ self.p["S"] + self.p["b"]
        if len(row):
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            pre[at[begins]] += np.add.reduceat(self.p["E"][row], begins, axis=0)
        return np.tanh(pre)

    def attend(self, h: np.ndarray, first: np.ndarray, head: str) -> tuple:
        """Of documents that all have passages: (score, weights, ...)."""
        begins = first[:-1]
        tv, su = np.tanh(h @ self.p["V" + head]), 1 / (1 + np.exp(-(h @ self.p["U" + head])))
        s = (tv * su) @ self.p["w" + head]
        n = np.diff(first)
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, begins), n))
        a = e / np.repeat(np.add.reduceat(e, begins), n)
        z = np.add.reduceat(h * a[:, None], begins, axis=0)
        y = 1 / (1 + np.exp(-(z @ self.p["c" + head] + self.p["d" + head])))
        return y, a, z, tv, su

    def score(self, b: Bags) -> dict[str, np.ndarray]:
        """Probabilities by head; NaN for documents without passages."""
        row = self.rows(b.word)
        known = row >= 0
        h = self.encode(row[known], b.word_at[known], b.shape)
        n = np.diff(b.first)
        has = n > 0
        out = {}
        for head in "qt":
            y = np.full(len(n), np.nan)
            if has.any():
                y[has] = self.attend(h, np.append(b.first[:-1][has], b.first[-1]), head)[0] if self.constant[head] is None else self.constant[head]
            out[head] = y
        return out

    def gradients(self, row, at, shape, first, labels: dict[str, np.ndarray], drop: np.ndarray) -> dict[str, np.ndarray]:  # noqa: ANN001
        row, at = row[drop], at[drop]
        h = self.encode(row, at, shape)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh, n = np.zeros_like(h), np.diff(first)
        for head in "qt":
            y, a, z, tv, su = self.attend(h, first, head)
            dy = ((y - labels[head]) / len(y)).astype(np.float32)
            g["c" + head], g["d" + head] = z.T @ dy, dy.sum(keepdims=True)
            dz = np.repeat(dy[:, None] * self.p["c" + head], n, axis=0)
            dh += dz * a[:, None]
            da = (dz * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(da * a, first[:-1]), n))
            g["w" + head] = (tv * su).T @ ds
            dg = ds[:, None] * self.p["w" + head]
            dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
            g["V" + head], g["U" + head] = h.T @ dv, h.T @ du
            dh += dv @ self.p["V" + head].T + du @ self.p["U" + head].T
        dpre = dh * (1 - h**2)
        g["S"], g["b"] = shape.T @ dpre, dpre.sum(0)
        if len(row):
            order = np.argsort(row, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(row[order]) > 0]))
            g["E"][row[order[begins]]] = np.add.reduceat(dpre[at[order]], begins, axis=0)
        return g


def _document_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, in how many documents each is), counted slice by slice."""
    seen = [np.zeros(0, K.U64)]
    for _, _, d, o in K.slices(data, off):
        b = bags(d, o)
        doc = np.repeat(np.arange(len(b.first) - 1), np.diff(b.first))[b.word_at]
        order = np.lexsort((doc, b.word))
        w, k = b.word[order], doc[order]
        seen.append(w[np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])])] if len(w) else w)
    return np.unique(np.concatenate(seen), return_counts=True)


def _known_bags(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the known words, their passages, shapes, first passage of each document): slice by slice, so that what isn't known is never held together."""
    rows, at, shape, n, n_pass = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros((0, N_SHAPES), np.float32)], [np.zeros(1, np.int64)], 0
    for _, _, d, o in K.slices(data, off):
        b = bags(d, o)
        r = model.rows(b.word)
        rows.append(r[r >= 0])
        at.append((b.word_at[r >= 0] + n_pass).astype(np.int32))
        shape.append(b.shape)
        n.append(np.diff(b.first))
        n_pass += int(b.first[-1])
    return np.concatenate(rows), np.concatenate(at), np.concatenate(shape), np.cumsum(np.concatenate(n))


def fit(texts: pa.Array, quality: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS, min_docs: int = MIN_DOCS, seed: int = 7) -> Model:
    """Adam over mini-batches of documents, at a falling rate, half of the words dropped each time; words in at least min_docs of the distinct texts make the vocabulary."""
    data, off = K.flat(texts)
    words, seen = _document_counts(data, off)
    model = Model(words[seen >= min_docs], seed)
    row, word_at, shape, first_passage = _known_bags(model, data, off)
    n = np.diff(first_passage)
    has = np.flatnonzero(n > 0)
    for head, y in (("q", quality), ("t", toxic)):
        if len(has) == 0 or len(set(y[has].tolist())) < 2:
            model.constant[head] = 1.0 if head == "q" else 0.0
    if len(has) == 0:
        return model
    rng = np.random.default_rng(seed)
    word_first = np.searchsorted(word_at, first_passage)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, parts = 0, max(1, len(has) // 64)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(has), parts):
            span = lambda starts: np.concatenate([np.arange(starts[d], starts[d + 1]) for d in part])  # noqa: E731,B023
            ps, ws = span(first_passage), span(word_first)
            first = np.concatenate([[0], np.cumsum(n[part])])
            local = np.full(int(first_passage[-1]), -1)
            local[ps] = np.arange(len(ps))
            r, at = row[ws], local[word_at[ws]]
            keep = rng.random(len(r)) > DROP
            g = model.gradients(r, at, shape[ps], first, {"q": quality[part], "t": toxic[part]}, keep)
            step += 1
            for k, x in model.p.items():
                grad = g[k] + (DECAY if k == "E" else 1e-5) * x
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad**2
                x -= RATE * (1 - (step - 1) / (parts * epochs)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most sample_rows labelled documents, by a hash of doc_id: (text, quality, toxic)."""
    few = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("double").alias("_q"), F.col("toxic").cast("double").alias("_t"))
        .groupBy("_id")
        .agg(F.max("_q").alias("_q"), F.max("_t").alias("_t"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    # sample_rows bounds what is broadcast
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("_d"), "text")
        .where("text is not null")
        .join(F.broadcast(few), F.col("_d") == F.col("_id"))
        .select("_d", "text", F.col("_q").alias("quality"), F.col("_t").alias("toxic"))
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model, made by one task from the sample's texts, each once, in the order of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        if t is None or not t.num_rows:
            t = pa.table({"_d": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "quality": pa.array([], pa.float64()), "toxic": pa.array([], pa.float64())})
        made = fit(t.column("text"), t.column("quality").to_numpy(), t.column("toxic").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    once = sample(docs, labels, sample_rows).groupBy("text").agg(F.min(F.struct("_d", "quality", "toxic")).alias("x")).select("x._d", "text", "x.quality", "x.toxic")
    rows = once.coalesce(1).sortWithinPartitions("_d", "text").mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit(pa.array([], pa.string()), np.zeros(0), np.zeros(0))


def _scores(model: Model, text: pa.Array) -> dict[str, np.ndarray]:
    data, off = K.flat(text)
    out = {h: np.full(len(text), np.nan) for h in "qt"}
    for lo, hi, d, o in K.slices(data, off):
        for h, y in model.score(bags(d, o)).items():
            out[h][lo:hi] = y
    return out


def _keep(s: dict[str, np.ndarray], min_quality: float, max_toxic: float) -> np.ndarray:
    return ~((s["q"] < min_quality) | (s["t"] > max_toxic))


def score(docs: DataFrame, model: Model, min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s[h], from_pandas=True) for h in "qt"), pa.array(_keep(s, min_quality, max_toxic))],
                names=["doc_id", "quality", "toxic", "keep"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, quality double, toxic double, keep boolean")


def keep_good(docs: DataFrame, model: Model, min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(shared.value, K.string_column(batch, "text"))
            yield batch.filter(pa.array(_keep(s, min_quality, max_toxic)))

    return docs.mapInArrow(run, docs.schema)
