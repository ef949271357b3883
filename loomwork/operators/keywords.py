"""Keyword discovery: TF-IDF, chi-squared selection, and coverage against cost for growing lists of keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import split_train_test

STOP_WORDS = (
    "a about above after again all also an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only "
    "or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your"
).split()


def terms(text: Column) -> Column:
    """Lower-cased words of at least two letters, digits or underscores, stop words left out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def tf_idf(docs: DataFrame, key: str, text: str, features: int = 2000, only: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): smoothed idf, rows of unit length, over the `features` terms that are most frequent in the corpus (ties by term). only: the keys that rows are wanted for; idf is that of all."""
    # counted a row at a time, where the words of a text are: only frequencies are shuffled
    words = docs.select(F.col(key), F.explode(terms(F.col(text))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    kept = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = docs.agg(F.count("*").alias("n"))
    # `features` bounds the side that is broadcast
    idf = kept.crossJoin(n).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    mine = tf if only is None else docs.join(only.select(key), key, "left_semi").select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    raw = mine.join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    # the terms of a document are few, and already together
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def chi2(weights: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(term, chi2, mean_1, mean_0) of the summed weights of two classes against their shares."""
    n = labels.agg(F.count("*").alias("n"), F.sum(label).alias("n1"))
    sums = (
        weights.join(labels.select(key, F.col(label).alias("_y")), key)
        .groupBy("term")
        .agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("_y")).alias("s1"))
        .crossJoin(n)
        .withColumn("e1", F.col("s") * F.col("n1") / F.col("n"))
        .withColumn("e0", F.col("s") - F.col("e1"))
    )
    s1, s0 = F.col("s1"), F.col("s") - F.col("s1")
    square = lambda o, e: F.coalesce(F.try_divide((o - e) * (o - e), e), F.lit(0.0))
    return sums.select(
        "term",
        (square(s1, F.col("e1")) + square(s0, F.col("e0"))).alias("chi2"),
        F.coalesce(F.try_divide(s1, F.col("n1")), F.lit(0.0)).alias("mean_1"),
        F.coalesce(F.try_divide(s0, F.col("n") - F.col("n1")), F.lit(0.0)).alias("mean_0"),
    )


def discover(docs: DataFrame, labels: DataFrame, key: str, text: str, top: int = 100, select: int = 500, features: int = 2000, digits: int = 6) -> DataFrame:
    """(rank, term, chi2): of the `select` terms of greatest chi-squared, the top ones that the positive class has more of. Scores are rounded, ties go by term."""
    w = tf_idf(docs, key, text, features, labels)
    best = chi2(w, labels, key).withColumn("chi2", F.round("chi2", digits)).orderBy(F.desc("chi2"), "term").limit(select)
    good = best.where(F.round("mean_1", digits + 3) > F.round("mean_0", digits + 3)).orderBy(F.desc("chi2"), "term").limit(top)
    return good.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("chi2"), "term"))).select("rank", "term", "chi2")


def coverage(chunks: DataFrame, keywords: list[str], relevant: Column, cost: Column) -> DataFrame:
    """(keywords, selected, coverage, saving) for the first 0, 1, 2 ... keywords, in one pass.

    Each chunk is given the rank of the first keyword that it contains; the
    rest is cumulative sums over ranks.
    """
    low = F.lower(F.col("chunk"))
    first = F.coalesce(*[F.when(low.contains(k.lower()), F.lit(i + 1)) for i, k in enumerate(keywords)]) if keywords else F.lit(None).cast("int")
    per = (
        chunks.select(first.alias("rank"), relevant.cast("bigint").alias("r"), cost.alias("c"))
        .groupBy("rank")
        .agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    )
    total = per.agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    steps = chunks.sparkSession.range(0, len(keywords) + 1).select(F.col("id").cast("int").alias("rank"))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    filled = steps.join(per, "rank", "left").select("rank", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(x) for x in "nrc"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return filled.crossJoin(total).select(
        F.col("rank").alias("keywords"),
        F.col("n").cast("bigint").alias("selected"),
        ratio(F.col("r"), F.col("all_r")).alias("coverage"),
        ratio(F.col("all_c") - F.col("c"), F.col("all_c")).alias("saving"),
    )


def sweep(docs: DataFrame, labels: DataFrame, key: str, text: str, cost: Column, top: int = 100, test: float = 0.2, **how: int) -> DataFrame:
    """(part, keywords, selected, coverage, saving): the whole curve of coverage against cost, for the first 0 to `top` keywords that the train part's labels give, on the train and on the test part of labelled documents."""
    train, rest = split_train_test(labels.where(F.col(key).isNotNull()), key, test)
    # `top` bounds what the driver sees
    words = [r["term"] for r in discover(docs, train, key, text, top, **how).orderBy("rank").collect()]
    out = []
    for part, some in (("train", train), ("test", rest)):
        rows = docs.join(some, key).withColumn("chunk", F.col(text))
        out.append(coverage(rows, words, F.col("label") == 1, cost).select(F.lit(part).alias("part"), "*"))
    return out[0].unionByName(out[1])
