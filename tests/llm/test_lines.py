from __future__ import annotations

import random

import numpy as np
import pytest
from loomwork.llm import lines
from loomwork.llm.store import Scratch

from .common import awkward, docs, nothing, words


def shingles(line: str, n: int) -> set[bytes]:
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in line.encode())
    return {b[i : i + n] for i in range(len(b) - n + 1)} or {b}


def jaccard(a: str, b: str, n: int = 8) -> float:
    x, y = shingles(a, n), shingles(b, n)
    return len(x & y) / len(x | y)


def like(a: str, b: str) -> bool:
    size = sorted([len(a.encode()), len(b.encode())])
    return size[0] >= lines.LONG and jaccard(a, b, 8) >= 0.8 or size[1] < lines.SHORT and jaccard(a, b, 4) >= 0.7


def brute_force(rows: list[tuple[int, str]]) -> dict[int, str | None]:
    """Exact: all pairs of lines, union-find, first occurrence by (doc_id, line) stays."""
    seen: dict[str, list[tuple[int, int]]] = {}
    for i, t in rows:
        n = 0
        for line in t.split("\n"):
            if line:
                if line.strip():
                    seen.setdefault(line, []).append((i, n))
                n += 1
    names = list(seen)
    parent = list(range(len(names)))

    def root(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(names)):
        for b in range(a):
            if like(names[a], names[b]):
                parent[root(a)] = root(b)
    groups: dict[int, list[tuple[int, int]]] = {}
    for a, name in enumerate(names):
        groups.setdefault(root(a), []).extend(seen[name])
    stay = {min(g) for g in groups.values()}
    out: dict[int, str | None] = {}
    for i, t in rows:
        kept, had, n = [], False, 0
        for line in t.split("\n"):
            ok = True
            if line:
                if line.strip():
                    had, ok = True, (i, n) in stay
                n += 1
            if ok:
                kept.append(line)
        gone = had and not any(x.strip() for x in kept)
        out[i] = None if gone else "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    line = lambda: " ".join(words(rng, rng.randrange(6, 14)))
    common = [line() for _ in range(12)]
    rows = []
    for i in range(120):
        body = []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.4:
                c = rng.choice(common)
                if rng.random() < 0.5:  # fuzzy: another case, or a short tail
                    c = rng.choice([c.upper(), c + " x", c[:1].upper() + c[1:]])
                body.append(c)
            else:
                body.append(line())
            if rng.random() < 0.1:
                body.append("")
        rows.append((i, "\n".join(body)))
    rows.append((500, rows[3][1]))  # all of it is a repetition
    return rows


def result(df) -> dict:
    return {r.doc_id: r.text for r in df.collect()}


def test_matches_brute_force(spark, corpus):
    got = result(lines.drop_duplicate_lines(docs(spark, corpus), Scratch(spark, "t")))
    want = {i: t for i, t in brute_force(corpus).items() if t is not None}
    assert 500 not in got
    same = sum(got.get(i, "").split("\n") == t.split("\n") for i, t in want.items())
    assert got.keys() == want.keys() and same >= 0.97 * len(want)


def test_join_gives_what_broadcast_gives(spark, corpus, monkeypatch):
    a = result(lines.drop_duplicate_lines(docs(spark, corpus), Scratch(spark, "t")))
    monkeypatch.setattr(lines, "MAX_BROADCAST_LINES", -1)
    assert result(lines.drop_duplicate_lines(docs(spark, corpus), Scratch(spark, "t"))) == a


def test_exact_jaccard():
    rng = random.Random(12)
    pairs = [(" ".join(words(rng, 8)), " ".join(words(rng, 8))) for _ in range(50)] + [("abc", "abc"), ("abc", "abd"), ("x" * 50, "x" * 70), ("", "")]
    a, b = zip(*pairs, strict=True)
    b = [x + y[: len(y) // 4] for x, y in zip(a, b, strict=True)]
    both, at = [x.encode() for x in (*a, *b)], np.arange(len(a))
    for n in (4, 8):
        got = lines.ShingleSets(both, n).jaccard(at, at + len(a))
        assert got.tolist() == pytest.approx([jaccard(x, y, n) for x, y in zip(a, b, strict=True)])
    assert lines.compare(both)(at, at + len(a)).tolist() == [like(x, y) for x, y in zip(a, b, strict=True)]


def test_one_edit_inside_a_short_line(spark):
    """Lines of 26 to 95 bytes of which one letter, digit or comma differs."""
    rng = random.Random(14)
    rows, base = [], []
    for i in range(300):
        a = ""
        while len(a) < 26 + i % 70:
            a += rng.choice(words(rng, 1)) + " "
        a = a[: 26 + i % 70].rstrip() + "z"
        k = rng.randrange(8, len(a) - 8)
        b = rng.choice([a[:k] + "#" + a[k + 1 :], a[:k] + "," + a[k:], a[:k] + a[k + 1 :]])
        rows += [(2 * i, a), (2 * i + 1, b)]
        base.append(like(a, b))
    assert sum(base) > 280
    kept = set(result(lines.drop_duplicate_lines(docs(spark, rows), Scratch(spark, "t"))))
    assert sum(2 * i + 1 not in kept for i, ok in enumerate(base) if ok) >= 0.95 * sum(base)


def test_families_of_edited_lines(spark):
    """Families of 30 lines of some 400 bytes with up to 4 words replaced: about the components that all pairs give (when written 2.5 % of the lines too many stayed, 24 % with one centre a bucket)."""
    rng = random.Random(15)
    rows, n = [], 0
    for _ in range(15):
        w = words(rng, 70)
        for _ in range(30):
            x = list(w)
            for _ in range(rng.randrange(5)):
                x[rng.randrange(len(x))] = words(rng, 1)[0]
            rows.append((n, " ".join(x)))
            n += 1
    exact = sum(t is not None for t in brute_force(rows).values())
    got = len(result(lines.drop_duplicate_lines(docs(spark, rows), Scratch(spark, "t"))))
    assert exact <= got <= exact + 0.04 * (n - exact), (exact, got)


def test_marks_tell_no_pair_wrongly():
    rng = random.Random(16)
    texts = []
    for _ in range(40):
        w = words(rng, rng.randrange(4, 60))
        for _ in range(6):
            w = [x if rng.random() < 0.96 else words(rng, 1)[0] for x in w]
            texts.append(" ".join(w).encode())
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    for n, least in ((8, 0.8), (4, 0.7)):
        s = lines.ShingleSets(texts, n)
        exact = s.jaccard(a, b) >= least
        assert (s.at_least(a, b, least) == exact).all() and len(texts) < exact.sum() < len(a) // 4


def plain_hash(line: bytes) -> int:
    """The hash of a line, byte by byte."""
    line, acc = line.lower(), 0
    for i, c in enumerate(line):
        acc += (c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64)
    return int(lines.K.mix(np.array([(acc + len(line)) % (1 << 64)], np.uint64))[0])


def test_runs_of_lines_change_nothing(monkeypatch):
    """Lines are hashed in runs of RUN bytes, of which a long line has more: names, blankness, buckets and sets don't hang on it."""
    rng = random.Random(18)
    texts = [b"\n".join([rng.choice([b"", b" \t", b"A", b" Bc"]), " ".join(words(rng, rng.randrange(1, 90))).encode()]) for _ in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    want = [x for t in texts for x in t.split(b"\n") if x]
    seen = []
    for run in (1, 50, 700, 1 << 15):
        monkeypatch.setattr(lines, "RUN", run)
        t, ink, uid = lines.split(data, off)
        assert ink.tolist() == [bool(x.strip()) for x in want] and uid.tolist() == [plain_hash(x) for x in want]
        key, line = lines.line_buckets(data, t.start, t.end)
        seen.append((key.tolist(), line.tolist(), [lines.ShingleSets(want, n).keys.tolist() for n in (4, 8)]))
    assert all(x == seen[0] for x in seen)


def bucket_links(texts: list[str]) -> dict[str, str]:
    """By brute force: of each line that is alike another one in one of its buckets, the least of those that it is linked to, by position."""
    raw = [t.encode() for t in texts]
    end = np.cumsum([len(x) for x in raw])
    key, line = lines.line_buckets(np.frombuffer(b"".join(raw), np.uint8), end - np.array([len(x) for x in raw]), end)
    buckets: dict[int, set[int]] = {}
    for k, i in zip(key.tolist(), line.tolist(), strict=True):
        buckets.setdefault(k, set()).add(i)
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for pair in {(x, y) for b in buckets.values() for x in b for y in b if x < y}:
        if like(texts[pair[0]], texts[pair[1]]):
            p, q = sorted(map(root, pair))
            parent[q] = p
    return {t: texts[root(i)] for i, t in enumerate(texts)}


def same_beginnings() -> list[str]:
    """Lines of one long beginning, in which most bands meet, whose ends are of many kinds."""
    rng = random.Random(17)
    same = " ".join(words(rng, 30))
    texts = []
    for _ in range(60):
        w = words(rng, 9)
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randrange(5)):
                x[rng.randrange(9)] = words(rng, 1)[0]
            texts.append(f"{same} {' '.join(x)}")
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    return texts


def test_no_pair_of_a_bucket_is_lost(spark):
    """As many stay as all pairs of the buckets give."""
    texts = same_beginnings()
    want = set(bucket_links(texts).values())
    got = set(result(lines.drop_duplicate_lines(docs(spark, list(enumerate(texts))), Scratch(spark, "t"))).values())
    assert got == want and 1 < len(want) < len(texts), (len(got), len(want), len(texts))


def test_banding_recall(spark):
    """Pairs at and above the threshold are found by the bands."""
    rng = random.Random(13)
    rows, pairs = [], []
    for i in range(400):
        a = " ".join(words(rng, 14))
        cut = rng.randrange(1, 8)
        b = a[:-cut] + "qqqqqqqq"[:cut] if rng.random() < 0.5 else a[cut:]
        if like(a, b):
            rows += [(2 * i, a), (2 * i + 1, b)]
            pairs.append(i)
    kept = set(result(lines.drop_duplicate_lines(docs(spark, rows), Scratch(spark, "t"))))
    assert sum(2 * i + 1 not in kept for i in pairs) >= 0.95 * len(pairs) and len(pairs) > 150


def test_one_line_of_each_component_stays_by_order(spark):
    a = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(3, f"{a}\nunique to three, nothing else has it"), (1, f"first of all\n{a}"), (2, a)]
    got = result(lines.drop_duplicate_lines(docs(spark, rows), Scratch(spark, "t")))
    assert got == {1: f"first of all\n{a}", 3: "unique to three, nothing else has it"}


def test_awkward_rows(spark, monkeypatch):
    df = awkward(spark)
    out = lines.drop_duplicate_lines(df, Scratch(spark, "t"))
    rows = out.collect()
    assert out.columns == df.columns
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[11] == ["the very same line of text here"]
    assert got[3] == [None] and got[4] == [""] and got[5] == [" \n\t "]
    assert 1 not in got and 2 not in got  # the null doc_id comes first
    assert None in got and sum(t is not None for t in got[None]) == 1
    monkeypatch.setattr(lines, "MAX_BROADCAST_LINES", -1)
    joined = lines.drop_duplicate_lines(df, Scratch(spark, "t"))
    assert joined.columns == df.columns and sorted(map(repr, joined.collect())) == sorted(map(repr, rows))


def test_empty_table(spark):
    assert lines.drop_duplicate_lines(nothing(spark), Scratch(spark, "t")).count() == 0
