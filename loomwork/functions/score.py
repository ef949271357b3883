"""Relevance scores of chunks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError


def _checked(words: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    if not isinstance(words, (list, tuple)) or not words:
        raise ConfigError("a scorer needs a list of keywords that isn't empty", keywords=words)
    return tuple(w.lower() for w in words)


@dataclass(frozen=True)
class KeywordScorer:
    """1 if any keyword is a substring of the chunk, whatever the case, else 0; null for a null chunk."""

    keywords: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "keywords", _checked(self.keywords))

    def column(self, chunk: Column) -> Column:
        low = F.lower(chunk)
        return reduce(lambda a, b: a | b, [low.contains(k) for k in self.keywords]).cast("double")

    def to_dict(self) -> dict:
        return {"type": "KeywordScorer", "keywords": list(self.keywords)}


def _lcs(a: str, masks: dict[str, int], m: int) -> int:
    """Length of the longest common subsequence with a pattern of m characters, bit-parallel."""
    s = (1 << m) - 1
    full = s
    for ch in a:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return m - s.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """Best similarity 2 LCS / (sum of lengths), in percent, of the shorter text with windows of the longer, those that hang over its ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    m, n = len(short), len(long)
    masks: dict[str, int] = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << i
    best = 0.0
    spans = [(0, e) for e in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
    for i, e in spans:
        # an optimal window begins or ends with a character of the shorter text
        if long[e - 1] not in masks and long[i] not in masks:
            continue
        if 200.0 * min(m, e - i) / (m + e - i) <= best:
            continue
        best = max(best, 200.0 * _lcs(long[i:e], masks, m) / (m + e - i))
    return best


@dataclass(frozen=True)
class FuzzyScorer:
    """Best partial ratio with any keyword, 0 to 1. Chunks that contain a keyword are scored natively; only the others reach Python."""

    keywords: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "keywords", _checked(self.keywords))

    def column(self, chunk: Column) -> Column:
        words = self.keywords

        @F.pandas_udf(T.DoubleType())
        def best(s: pd.Series) -> pd.Series:
            seen: dict[str, float] = {}
            for t in s:
                if t is not None and t not in seen:
                    seen[t] = max(partial_ratio(t, k) for k in words) / 100
            return s.map(seen)

        low = F.lower(chunk)
        exact = reduce(lambda a, b: a | b, [low.contains(k) for k in words])
        # the UDF is given null for what needs none, since it runs before the condition is looked at
        return F.when(exact, F.lit(1.0)).otherwise(best(F.when(~exact, low)))

    def to_dict(self) -> dict:
        return {"type": "FuzzyScorer", "keywords": list(self.keywords)}


@dataclass(frozen=True)
class UdfScorer:
    """A scorer made of a Python function text -> number."""

    function: object

    def column(self, chunk: Column) -> Column:
        f = self.function

        @F.pandas_udf(T.DoubleType())
        def one(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else float(f(t)))

        return one(chunk)

    def to_dict(self) -> dict:
        return {"type": "UdfScorer"}


Scorer = KeywordScorer | FuzzyScorer | UdfScorer
SCORERS = {"KeywordScorer": KeywordScorer, "FuzzyScorer": FuzzyScorer}


def scorer(d: dict | None) -> Scorer | None:
    kind = (d or {}).get("type")
    if kind in (None, "None"):
        return None
    if kind not in SCORERS:
        raise ConfigError(f"unknown scorer {kind!r}; known: {', '.join(SCORERS)}, None", type=kind)
    return SCORERS[kind](tuple(d.get("keywords", ())))
