"""Tables that the tests of this folder share."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that operators use inside
CLASHES = ["id", "root", "key", "uid", "bucket", "sig", "sig_hash", "_gone", "own", "shard", "h", "centre", "_id", "_drop", "line", "n", "gram", "p"]


def docs(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return ["w" + format(rng.randrange(vocabulary), "x").translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n)]


def text(rng: random.Random, n: int) -> str:
    w = words(rng, n)
    return " ".join(x + ("." if i % 9 == 8 else "") + ("\n" if i % 40 == 39 else "") for i, x in enumerate(w))


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, and extra columns with clashing names."""
    rng = random.Random(1)
    same = text(rng, 120)
    rows = [
        (None, same), (1, same), (1, same), (2, same), (3, None), (4, ""), (5, " \n\t "), (6, "!!! ..."), (7, "one"), (7, "two words"),
        (None, None), (8, text(rng, 60_000)), (9, "ü" * 3000), (10, "a\n\n\na\r\nb\n"), (11, "\n".join(["the very same line of text here"] * 50)), (12, "x" * 100_000),
        (13, "call 5 or mail me@x.org, me@x.org"), (-4, same + " more"), (1 << 40, "far away"),
    ]
    df = spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else "s", None) for k, (i, t) in enumerate(rows)], SCHEMA)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def letter_words(t: str) -> list[str]:
    """Words as the operators have them: runs of letters and digits of ASCII, and of all that isn't ASCII."""
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t.lower())
