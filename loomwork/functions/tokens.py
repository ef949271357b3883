"""Token counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def approx_tokens(text: Column) -> Column:
    """An approximation: a quarter of the characters, rounded up. Native, and the same in any SQL engine."""
    return F.ceil(F.length(text) / F.lit(4)).cast("bigint")


@lru_cache(maxsize=4)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _runs(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in runs of up to so many characters (a longer one alone): what a tokenizer makes of a text is many times its size."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def exact_tokens(text: Column, path: str) -> Column:
    """Tokens by a tokenizer file, which every executor has at `path`."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        known = s.dropna()
        n = [len(e.ids) for run in _runs(known.tolist()) for e in _tokenizer(path).encode_batch(run, add_special_tokens=False)]
        return pd.Series(n, index=known.index, dtype="Int64").reindex(s.index)

    return count(text)
