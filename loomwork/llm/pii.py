"""Personal data by bootstrapped contextual extraction.

Candidates are pieces with a digit or an at sign of tokens (neighbouring
pieces of a number are one candidate), what follows a label (password, secret,
token, key, user), and long mixtures of capital and small letters. A strict rule is searched for within a
token, so that brackets, labels, quotes and separators around a value don't
hide it, and a token may hold several; what is left of it is cut at quotes,
separators and brackets, and labels are context. Seeds are candidates that a strict rule knows
(e-mail and IP addresses, international telephone numbers, card numbers with
a right check digit, access keys, labelled secrets) and, as counter-examples,
numerals of at most four digits. Each candidate gives patterns of its form and of its
context. Spark scores the graph of patterns and instances in turns:

    confidence of a pattern for a kind
        = mass of that kind / (mass of all kinds + counter-examples + 1/2)
          over its distinct instances, if it has SUPPORT known ones
    score of an instance = 1 - product over its patterns of (1 - confidence)

and instances that reach ACCEPT count as known in the next turn, so that
patterns discover identifiers that no rule knows (such as card numbers with a
wrong check digit), and those induce further patterns.

Texts are not shuffled: candidates, some for each few documents, are. The
patterns that are confident at the end are few (their number follows the
kinds of identifiers, not the documents); they are broadcast up to
MAX_BROADCAST_PATTERNS, beyond which spans are found by a join.

A pattern is an abstraction, so it may abbreviate: a form of more than 24 runs
is its first 24 and its length, a coarse form its first 24 signs, a right
neighbour its first 16. Words of letters alone that follow no label are no
candidates: nothing tells them from other words.

Defined results for odd input: null and empty texts hold nothing and stay as
they are; very long texts and tokens are searched whole; doc_id may be null or
repeated, but rows that are the same altogether have their identifiers told
once; of kinds of equal score (to nine digits) the least by name is taken, of
rules that match the same place the first; an empty table gives an empty
result; other columns are kept by redact and ignored by find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Scratch, unused

TURNS, SUPPORT, ACCEPT, MAX_BROADCAST_PATTERNS = 3, 3, 0.8, 500_000

_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 58, 61, 64]] = True
LONG = 16
_PIECE = re.compile(r"[+(]*\d[\d()\-]{0,8}")
_EDGE = " \t.,;:!?\"'`#$%&*<>[]{}|~^/\\"
_BARE = _EDGE + "()=-"
_EMAIL = re.compile(r"[^\W_][\w.%+\-]*@[^\W_][\w\-]*(\.[\w\-]+)+")
_EMAIL_IN = re.compile(r"(?<![\w.%+\-])[\w.%+\-]+@[^\W_][\w\-]*(?:\.[\w\-]+)+(?<=[^\W_])")
_PHONE = re.compile(r"\+\d{1,3}[ \-.]?\(?\d{2,4}\)?[ \-.]?\d{3,4}[ \-.]\d{3,4}")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}", re.I)
_SECRET = re.compile(r"(?:password|passwd|secret|api_?key|token)[\"']?[=:](?:\"[^\"\s]{6,}|'[^'\s]{6,}|(?![\"'])(?:(?![;,&][\"']?\w+[\"']?[=:]|[<>])\S){6,})", re.I)
_HEX = re.compile(r"[0-9a-f]{32,}", re.I)
_LABEL = re.compile(r"(?:token|secret|password|key)[\"']?\s*[=:]$", re.I)
_IP_IN = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
_PHONE_IN = re.compile(r"(?<![\w+])" + _PHONE.pattern + r"(?!\d)")
_KEY_IN = re.compile(r"(?<![^\W_])" + _KEY.pattern + r"(?![^\W_])", re.I)
_CARD_IN = re.compile(r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w)")
_PREFIX = re.compile(r"[\"'(\[{<]*(?:[A-Za-z_]+[\"']?[:=])?[\"'(]*")
_PART = re.compile(r"(?:(?!,\D)[^;|<>{}\[\]\"'`=&])+")
_NAME = re.compile(r"[A-Za-z_][\w.\-]*:+(?=[^:/]+$)")
_LABELLED = re.compile(r"(?<![^\W_])(password|passwd|secret|api_?key|token|key|user)(?:name)?[\"']?\s*[=:]+$", re.I)
_MIXED = re.compile(r"\d.*[^\W\d_]|[^\W\d_].*\d")
_NUMERAL = re.compile(r"(?:(?![@_])[\d\W])+")
_RUNS = re.compile(r"\d+|[^\W\d_]+|[\s\S]")
KINDS = ["EMAIL", "PHONE", "IP", "CARD", "KEY", "SECRET"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def seed(value: str, left: str) -> str | None:
    """The kind that a rule knows the value to be, "NONE" for a counter-example, None for what no rule knows."""
    if _EMAIL.fullmatch(value):
        return "EMAIL"
    if (m := _IP.fullmatch(value)) and all(int(g) < 256 for g in m.groups()):
        return "IP"
    if _PHONE.fullmatch(value):
        return "PHONE"
    if _KEY.fullmatch(value):
        return "KEY"
    if _SECRET.fullmatch(value) or (_HEX.fullmatch(value) and _LABEL.search(left)):
        return "SECRET"
    digits = value.replace(" ", "").replace("-", "")
    if digits.isdecimal() and digits.isascii() and 13 <= len(digits) <= 19 and luhn(digits):
        return "CARD"
    if (m := _LABELLED.search(left)) and m.group(1) not in ("key", "user") and len(value) >= 6 and " " not in value and _MIXED.search(value):
        return "SECRET"
    if _NUMERAL.fullmatch(value) and sum(c.isdecimal() for c in value) <= 4:
        return "NONE"
    return None


def rule_spans(text: str) -> list[tuple[int, int]]:
    """Where the rules match within a token, in order; of overlapping ones the first rule's."""
    out: list[tuple[int, int]] = []
    for rule in (_SECRET, _EMAIL_IN, _KEY_IN, _IP_IN, _PHONE_IN, _CARD_IN):
        if rule is _EMAIL_IN and "@" not in text:
            continue
        for m in rule.finditer(text):
            a, b = m.span()
            if rule is _SECRET:
                b = a + len(m.group().rstrip(_EDGE + ")"))
            elif rule is _EMAIL_IN:
                a = b - len(m.group().lstrip("_.%+-"))
            if seed(text[a:b], "") not in (None, "NONE") and all(b <= x or y <= a for x, y in out):
                out.append((a, b))
    return sorted(out)


def _is_long_mixture(value: str) -> bool:
    return len(value) >= LONG and value.isalnum() and re.search(r"[a-z]", value) is not None and re.search(r"[A-Z]", value[1:]) is not None


def pieces(text: str, before: str = "") -> list[tuple[int, int]]:
    """Where the candidates of a token are: what rules match, and of the rest the parts between quotes, separators and brackets, without labels. What follows a label is one, whatever it has."""
    spans, lo = [], 0
    known = rule_spans(text)
    if not known and _LABELLED.search(before):
        core = text.strip(_EDGE + ("()" if text.count("(") != text.count(")") or text[0] == "(" else ""))
        if core:
            return [(text.find(core), text.find(core) + len(core))]
    for a, b in [*known, (len(text), len(text))]:
        for m in _PART.finditer(text, lo, a):
            part, at = m.group(), m.start()
            head = len(part) - len(part.lstrip(_EDGE))
            core = part.strip(_EDGE)
            if name := _NAME.match(core):
                head, core = head + name.end(), core[name.end() :]
            if core.count("(") != core.count(")") or (core[:1] == "(" and core[-1:] == ")" and core.find(")") == len(core) - 1):
                inner = core.strip("()")
                head, core = head + core.find(inner), inner
            if any(c.isdecimal() or c == "@" for c in core) or core and (_LABELLED.search(text[: at + head].rstrip("\"'")) or _is_long_mixture(core)):
                spans.append((at + head, at + head + len(core)))
        lo = b
    return sorted(spans + known)


def shape(value: str) -> str:
    """Form of a value: a long mixture is only its alphabet and length, else runs with lengths of digits and letters."""
    if len(value) >= 16 and value.isalnum() and not value.isdecimal():
        return f"{'h' if _HEX.fullmatch(value) else 'U' if value.isupper() else 'm'}{len(value)}"
    out = []
    for r in _RUNS.findall(value):
        out.append(f"9{len(r)}" if r[0].isdecimal() else ("A" if r.isupper() else "a") if r[0].isalpha() else r)
    return "".join(out) if len(out) <= 24 else "".join(out[:24]) + f"+{len(value)}"


def coarse(value: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", value)))[:24]


def patterns(value: str, left: str, right: str) -> list[str]:
    """Lexical patterns of a candidate: its form, its form after the words before it, its opening letters, its form between its neighbours."""
    s, words = shape(value), [w for x in left.casefold().split() if (w := x.strip(_BARE))]
    out = ["form " + s]
    if words:
        out.append("after " + " ".join(words[-2:]) + " > " + re.sub(r"\d+", "", coarse(value)).replace("-", " "))
        out.append("between " + words[-1] + " > " + s + " < " + right.casefold()[:16])
    if m := _LABELLED.search(left):
        out.append("label " + m.group(1).casefold())
    if (m := re.match(r"[^\W\d_]{4}", value)) and len(value) >= 8:
        out.append("opens " + m.group().casefold() + " > " + str(len(value)))
    return out


def candidates(d: np.ndarray, o: np.ndarray) -> Iterator[tuple[int, int, int, str, str, str]]:
    """(document, start and end in bytes within the slice, value, text before, token after)."""
    t = K.tokens(d, o, K.NONSPACE)
    marked = np.unique(np.searchsorted(t.start, np.flatnonzero(_MARK[d]), "right") - 1)
    # what follows a token that ends in : or =
    last = d[t.end[marked] - 1] if len(marked) else marked
    follows = marked[(last == 58) | (last == 61)] + 1
    capitals, small = (np.concatenate([[0], np.cumsum((d >= c) & (d < c + 26))]) for c in (65, 97))
    long = np.flatnonzero((t.end - t.start >= LONG) & (capitals[t.end] - capitals[t.start + 1] > 0) & (small[t.end] - small[t.start] > 0)) if len(t.start) else marked
    tok = np.unique(np.concatenate([marked, follows[follows < len(t.start)], long]))
    if not len(tok):
        return
    doc = (np.searchsorted(t.first, tok, "right") - 1).tolist()
    raw, first = d.tobytes(), t.first.tolist()
    starts, ends, toks = t.start, t.end, tok.tolist()
    i = 0
    while i < len(toks):
        k, who = toks[i], doc[i]
        a, b = int(starts[k]), int(ends[k])
        text = raw[a:b].decode("utf-8", "replace")
        j = i
        if _PIECE.fullmatch(text[_PREFIX.match(text).end() :].rstrip("!#$%&*")):
            while j + 1 < len(toks) and toks[j + 1] == toks[j] + 1 and doc[j + 1] == who and starts[toks[j + 1]] == b + 1:
                more = raw[starts[toks[j + 1]] : ends[toks[j + 1]]].decode("utf-8", "replace")
                if not _PIECE.fullmatch(more.strip(_EDGE)) or more[0] == "+":
                    break
                j += 1
                b = int(ends[toks[j]])
            text = raw[a:b].decode("utf-8", "replace")
        before = raw[int(starts[max(first[who], k - 2)]) : a].decode("utf-8", "replace")
        spans = pieces(text, before.rstrip(" \"'"))
        if spans:
            nxt = toks[j] + 1
            after = raw[int(starts[nxt]) : int(ends[nxt])].decode("utf-8", "replace") if nxt < first[who + 1] else ""
        for x, y in spans:
            s = a + len(text[:x].encode())
            yield who, s, s + len(text[x:y].encode()), text[x:y], (before + text[:x]).strip(" \"'([{<"), text[y:].strip(_BARE) or after
        i = j + 1


_SCHEMA = "key struct<a:bigint,b:bigint>, doc_id bigint, start int, end int, value string, seed string, patterns array<string>"


def _key(text: str | Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def scan(docs: DataFrame) -> DataFrame:
    """Every candidate: start and end are bytes of the UTF-8 text; key names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            data, off = K.flat(batch.column(2))
            for lo, _, d, o in K.slices(data, off):
                rows = list(candidates(d, o))
                who = pa.array([r[0] + lo for r in rows], pa.int64())
                begin = o[[r[0] for r in rows]] if rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(who),
                        ids.take(who),
                        pa.array(np.array([r[1] for r in rows], np.int64) - begin).cast(pa.int32()),
                        pa.array(np.array([r[2] for r in rows], np.int64) - begin).cast(pa.int32()),
                        pa.array([r[3] for r in rows], pa.string()),
                        pa.array([seed(r[3], r[4]) for r in rows], pa.string()),
                        pa.array([patterns(r[3], r[4], r[5]) for r in rows], pa.list_(pa.string())),
                    ],
                    names=["key", "doc_id", "start", "end", "value", "seed", "patterns"],
                )

    return docs.select(_key("text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(run, _SCHEMA)


def _best(score: str):  # noqa: ANN202
    """Column of which the least is the best: the greatest score, of equals the least kind."""
    return F.struct((-F.round(score, 9)).alias("less"), "kind")


def bootstrap(found: DataFrame, scratch: Scratch, turns: int = TURNS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns."""
    edges = scratch.save(found.select(F.explode("patterns").alias("pattern"), "value", "seed").distinct())
    # a value that some context makes a seed is one
    seeds = edges.groupBy("value").agg(F.max(F.when(F.col("seed") != "NONE", F.col("seed"))).alias("kind"), F.max((F.col("seed") == "NONE").cast("int")).alias("none"))
    known = seeds.where("kind is not null or none = 1").select("value", F.coalesce("kind", F.lit("NONE")).alias("kind"), F.lit(1.0).alias("mass"))
    links = scratch.save(edges.select("pattern", "value").distinct())
    confident = None
    for turn in range(turns):
        known = scratch.save(known)
        mass = links.join(known, "value").groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"), F.count("*").alias("n"))
        total = mass.groupBy("pattern").agg(F.sum("mass").alias("all"), F.min(F.when(F.col("kind") != "NONE", F.struct((-F.round("mass", 9)).alias("less"), "kind", "n", "mass"))).alias("top"))
        confident = scratch.save(
            total.where(F.col("top.n") >= support)
            .select("pattern", "top.kind", (F.col("top.mass") / (F.col("all") + 0.5)).alias("confidence"))
            .where(F.col("confidence") >= accept)
        )
        if turn + 1 < turns:
            fresh = (
                links.join(confident, "pattern")
                .join(known.select("value"), "value", "left_anti")
                .groupBy("value", "kind")
                .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))).alias("mass"))
                .groupBy("value")
                .agg(F.min(_best("mass")).alias("x"))
                .select("value", "x.kind", (-F.col("x.less")).alias("mass"))
                .where(F.col("mass") >= accept)
            )
            known = known.unionByName(fresh)
    return confident


def decide(kind: str | None, names: list[str], confident: dict[str, tuple[str, float]], accept: float) -> tuple[str, float] | None:
    """(kind, score) of an instance, None if it isn't taken for an identifier."""
    if kind == "NONE":
        return None
    if kind is not None:
        return kind, 1.0
    miss: dict[str, float] = {}
    for p in names:
        if p in confident:
            k, c = confident[p]
            miss[k] = miss.get(k, 1.0) * (1 - c)
    if not miss:
        return None
    less, k = min((-round(1 - m, 9), k) for k, m in miss.items())
    return (k, -less) if -less >= accept else None


def _spans(found: DataFrame, confident: DataFrame, accept: float) -> DataFrame:
    """Candidates that are identifiers, with kind and score, by joins alone."""
    rows = found.where("seed is null or seed <> 'NONE'").withColumn("row", F.struct("key", "doc_id", "start", "end", "value"))
    sure = rows.where("seed is not null").select("row", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    rest = (
        rows.where("seed is null")
        .select("row", F.explode(F.array_distinct("patterns")).alias("pattern"))
        .join(confident, "pattern")
        .groupBy("row", "kind")
        .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))).alias("score"))
        .groupBy("row")
        .agg(F.min(_best("score")).alias("x"))
        .select("row", "x.kind", (-F.col("x.less")).alias("score"))
        .where(F.col("score") >= accept)
    )
    return sure.unionByName(rest).select("row.*", "kind", F.round("score", 6).alias("score")).distinct()


def find(docs: DataFrame, scratch: Scratch, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, kind, value, start, end, score) of every identifier; start and end are bytes of the UTF-8 text."""
    found = scratch.save(scan(docs))
    return _spans(found, bootstrap(found, scratch, accept=accept), accept).select("doc_id", "kind", "value", "start", "end", "score")


def _redacted(text: pa.Array, spans: dict[int, list[tuple[int, int, str]]]) -> pa.Array:
    if not spans:
        return text
    out = text.to_pylist()
    for i, found in spans.items():
        raw = out[i].encode()
        for a, b, kind in sorted(found, reverse=True):
            raw = raw[:a] + b"[" + kind.encode() + b"]" + raw[b:]
        out[i] = raw.decode("utf-8", "replace")
    return pa.array(out, text.type)


def redact(docs: DataFrame, scratch: Scratch, accept: float = ACCEPT) -> DataFrame:
    """docs with every identifier replaced by its kind in brackets."""
    found = scratch.save(scan(docs))
    confident = bootstrap(found, scratch, accept=accept)
    names = docs.columns
    at = names.index("text")
    if confident.count() > MAX_BROADCAST_PATTERNS:
        spans = _spans(found, confident, accept).groupBy("key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("_spans"))
        joined = docs.join(spans, _key(docs["text"]) == spans["key"], "left").select(*[docs[c] for c in names], spans["_spans"].alias(unused("_spans", names)))

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                per = {i: [(x["start"], x["end"], x["kind"]) for x in s] for i, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if s}
                yield pa.RecordBatch.from_arrays([_redacted(batch.column(j), per) if j == at else batch.column(j) for j in range(len(names))], names=names)

        return joined.mapInArrow(run_joined, docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast({r["pattern"]: (r["kind"], r["confidence"]) for r in confident.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per: dict[int, list[tuple[int, int, str]]] = {}
            data, off = K.flat(batch.column(at))
            for lo, _, d, o in K.slices(data, off):
                for who, a, b, value, left, right in candidates(d, o):
                    if got := decide(seed(value, left), patterns(value, left, right), shared.value, accept):
                        per.setdefault(lo + who, []).append((int(a - o[who]), int(b - o[who]), got[0]))
            yield pa.RecordBatch.from_arrays([_redacted(batch.column(j), per) if j == at else batch.column(j) for j in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)
