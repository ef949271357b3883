"""Splitting and trimming text, as native Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError

# what str.strip() takes off; Java's \s alone is ASCII
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Text without white space, in the Unicode sense, at its ends."""
    return F.trim(c, F.lit(_SPACES))


def filled(pieces: Column) -> Column:
    """Stripped pieces of an array that aren't empty."""
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


@dataclass(frozen=True)
class ParagraphSplit:
    """Blank lines end paragraphs."""

    def column(self, text: Column) -> Column:
        return filled(F.split(text, rf"\r?\n{SPACE}*\r?\n", -1))

    def to_dict(self) -> dict:
        return {"type": "ParagraphSplit"}


@dataclass(frozen=True)
class FixedWindowSplit:
    """Windows of `window` sentences that begin every `stride` sentences; short ones at the end are kept."""

    window: int = 5
    stride: int | None = None

    def __post_init__(self) -> None:
        if self.window < 1 or (self.stride or 1) < 1:
            raise ConfigError("window and stride are positive", window=self.window, stride=self.stride)

    def column(self, text: Column) -> Column:
        step = self.stride or self.window
        sentences = filled(F.split(text, rf"(?<=[.!?]){SPACE}+", -1))
        # the array is bound once by the outer lambda; otherwise every window would split the text again
        windows = F.transform(
            F.array(sentences),
            lambda s: F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(step)), lambda i: F.array_join(F.slice(s, i + 1, self.window), " "))
            ),
        )
        return F.when(text.isNotNull(), F.element_at(windows, 1))

    def to_dict(self) -> dict:
        return {"type": "FixedWindowSplit", "window": self.window, "stride": self.stride or self.window}


@dataclass(frozen=True)
class RegexSplit:
    """Pieces between matches. Patterns that Java reads in another way than Python does (groups, named groups, conditionals, \\Z) run in an Arrow UDF."""

    pattern: str = "\n\n"

    def __post_init__(self) -> None:
        try:
            re.compile(self.pattern)
        except re.error as e:
            raise ConfigError(f"invalid pattern {self.pattern!r}: {e}", pattern=self.pattern) from e

    @property
    def portable(self) -> bool:
        return re.compile(self.pattern).groups == 0 and not re.search(r"\\[Zwdbs]|\(\?[P(aiLmsux]|(?<!\\)\[[^\]]*(\[|&&)", self.pattern)

    def column(self, text: Column) -> Column:
        if self.portable:
            return filled(F.split(text, self.pattern, -1))
        compiled = re.compile(self.pattern)

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def pieces(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else [p.strip() for p in compiled.split(t) if p is not None and p.strip()])

        return pieces(text)

    def to_dict(self) -> dict:
        return {"type": "RegexSplit", "pattern": self.pattern}


@dataclass(frozen=True)
class UdfSplit:
    """A splitter made of a Python function text -> list of pieces."""

    function: object

    def column(self, text: Column) -> Column:
        f = self.function

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def pieces(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else list(f(t)))

        return pieces(text)

    def to_dict(self) -> dict:
        return {"type": "UdfSplit"}


Splitter = ParagraphSplit | FixedWindowSplit | RegexSplit | UdfSplit
SPLITTERS = {
    "ParagraphSplit": lambda d: ParagraphSplit(),
    # stride 5 whatever the window: the default of a configuration
    "FixedWindowSplit": lambda d: FixedWindowSplit(d.get("window", 5), d.get("stride", 5)),
    "RegexSplit": lambda d: RegexSplit(d.get("pattern", "\n\n")),
}


def splitter(d: dict | None) -> Splitter | None:
    kind = (d or {}).get("type")
    if kind in (None, "None"):
        return None
    if kind not in SPLITTERS:
        raise ConfigError(f"unknown splitter {kind!r}; known: {', '.join(SPLITTERS)}, None", type=kind)
    return SPLITTERS[kind](d)
