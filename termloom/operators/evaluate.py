"""Evaluation of runs against relevance judgements."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MEASURES = ("p10", "ap", "ndcg10", "rprec")


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run(model, qid, rank, doc_id) with rel (1 if relevant), the relevant ones so far and r, the number of relevant documents."""
    rel = qrels.filter("label > 0").select("qid", "doc_id", F.lit(1).alias("rel")).distinct()
    total = rel.groupBy("qid").agg(F.count("*").alias("r"))
    w = Window.partitionBy("model", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = run.join(rel, ["qid", "doc_id"], "left").join(total, "qid", "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return rows.withColumn("seen", F.sum("rel").over(w))


def per_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(model, qid, p10, ap, ndcg10, rprec): null for queries without relevant documents; queries absent from the run are absent."""
    j, rel, rank = judged(run, qrels), F.col("rel"), F.col("rank")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("r"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = j.groupBy("model", "qid").agg(
        F.max("r").alias("r"), (F.count_if((rank < 10) & (rel == 1)) / 10).alias("p10"),
        F.sum(F.when(rel == 1, F.col("seen") / (rank + 1)).otherwise(0.0)).alias("s"),
        F.sum(F.when((rank < 10) & (rel == 1), 1 / F.log2(rank + 2.0)).otherwise(0.0)).alias("dcg"), F.count_if((rank < F.col("r")) & (rel == 1)).alias("inr"),
    )
    has = F.col("r").isNotNull()
    return out.select(
        "model", "qid", F.when(has, F.col("p10")).alias("p10"), F.when(has, F.col("s") / F.col("r")).alias("ap"),
        F.when(has, F.col("dcg") / ideal).alias("ndcg10"), F.when(has, F.col("inr") / F.col("r")).alias("rprec"),
    )


def interpolated(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(model, qid, level, precision): the largest precision at a recall of at least level, for the eleven levels 0 to 1."""
    j = judged(run, qrels)
    levels = F.explode(F.sequence(F.lit(0), F.lit(10))).alias("level10")
    at = F.when((F.col("rel") == 1) & (F.col("seen") * 10 >= F.col("level10") * F.col("r")), F.col("seen") / (F.col("rank") + 1))
    out = j.select("*", levels).groupBy("model", "qid", "level10").agg(F.max(at).alias("p"), F.max("r").alias("r"))
    return out.select("model", "qid", (F.col("level10") / 10).alias("level"), F.when(F.col("r").isNotNull(), F.coalesce("p", F.lit(0.0))).alias("precision"))


def containing(docs: DataFrame, topics: DataFrame, run: int = 4) -> DataFrame:
    """(qid, doc_id) of docs(doc_id, text) that contain the text of topics(qid, text), character by character.

    The words within a topic, without its first and last, which may be parts of longer ones, stand in each such document: the first run of
    them is a key, and documents meet topics by the keys of their runs of words that begin like one; only what meets is compared. Topics of fewer words are
    held against all documents; they are broadcast, as a set of queries.
    """
    words = lambda c: F.split(c, r"\s+")
    keyed = topics.select("qid", F.col("text").alias("passage"), F.slice(words("text"), 2, run).alias("w"), (F.size(words("text")) >= run + 2).alias("long"))
    key = lambda w: F.xxhash64(F.array_join(w, " "))
    known = docs.select("doc_id", "text")
    long = keyed.filter("long").select("qid", "passage", key("w").alias("key"))
    asked = [r["key"] for r in long.select("key").distinct().collect()]
    firsts = [r["f"] for r in keyed.filter("long").select(F.col("w")[0].alias("f")).distinct().collect()]
    places = F.filter(F.sequence(F.lit(1), F.size("w") - run + 1), lambda i: F.element_at("w", i).isin(firsts))
    runs = F.transform(places, lambda i: key(F.slice("w", i, run)))
    # only keys of topics leave a document's task, with its text; outer, since else the keys would be made a second time for a filter
    keys = F.filter(F.array_distinct(runs), lambda x: x.isin(asked))
    starts = known.select("doc_id", "text", words("text").alias("w")).filter(F.size("w") >= run).select("doc_id", "text", F.explode_outer(keys).alias("key"))
    texts = starts.join(F.broadcast(long), "key")
    short = known.join(F.broadcast(keyed.filter("not long").select("qid", "passage")), F.expr("contains(text, passage)"))
    return texts.filter(F.expr("contains(text, passage)")).select("qid", "doc_id").union(short.select("qid", "doc_id")).distinct()


def means(measured: DataFrame) -> DataFrame:
    return measured.groupBy("model").agg(*[F.round(F.avg(m), 6).alias(m) for m in MEASURES])


def experiment(measured: DataFrame, topics: DataFrame) -> DataFrame:
    """Means over all topics, where a missing query or value counts as 0."""
    every = measured.select("model").distinct().crossJoin(topics.select("qid").distinct())
    full = every.join(measured, ["model", "qid"], "left").select("model", "qid", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MEASURES])
    return means(full)


def describe(measured: DataFrame, measure: str = "ap") -> DataFrame:
    q = [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
    return measured.groupBy("model").agg(
        F.count(measure).alias("n"), F.round(F.avg(measure), 6).alias("mean"), F.round(F.stddev_samp(measure), 6).alias("std"), F.round(F.min(measure), 6).alias("min"),
        *[F.round(F.percentile(measure, p), 6).alias(n) for p, n in q], F.round(F.max(measure), 6).alias("max"),
    )


def histogram(measured: DataFrame, measure: str = "ap", bins: int = 10) -> DataFrame:
    """(model, bin, n): equal bins over the range of a model's values."""
    ends = measured.groupBy("model").agg(F.min(measure).alias("lo"), F.max(measure).alias("hi"))
    x = F.col(measure)
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) * bins / (F.col("hi") - F.col("lo")) + 1e-9), F.lit(bins - 1))).otherwise(0)
    return measured.filter(x.isNotNull()).join(F.broadcast(ends), "model").groupBy("model", at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def compare(measured: DataFrame, a: str, b: str, measure: str = "ap") -> DataFrame:
    """Wins, losses and ties of b against a over queries that both have."""
    pair = _paired(measured, a, b, measure)
    return pair.agg(F.count_if(F.col("y") > F.col("x")).alias("wins"), F.count_if(F.col("y") < F.col("x")).alias("losses"), F.count_if(F.col("y") == F.col("x")).alias("ties"))


def baseline(measured: DataFrame, base: str, measure: str = "ap") -> DataFrame:
    """(model, better, worse, t): each model against the base, with the paired t statistic of rounded differences."""
    x = measured.filter(F.col("model") == base).select("qid", F.round(measure, 9).alias("x"))
    d = measured.filter(F.col("model") != base).select("model", "qid", F.round(measure, 9).alias("y")).join(x, "qid").dropna().withColumn("d", F.col("y") - F.col("x"))
    t = F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d").cast("double")))
    return d.groupBy("model").agg(F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.when(F.stddev_samp("d") > 0, F.round(t, 4)).alias("t"))


def _paired(measured: DataFrame, a: str, b: str, measure: str) -> DataFrame:
    side = lambda m, name: measured.filter(F.col("model") == m).select("qid", F.round(measure, 9).alias(name)).dropna()
    return side(a, "x").join(side(b, "y"), "qid")


def common_queries(measured: DataFrame, models: tuple[str, ...], measure: str = "ap") -> DataFrame:
    """(qid, a column for each model): values of the queries that all of the models have."""
    out = None
    for m in models:
        side = measured.filter(F.col("model") == m).select("qid", F.col(measure).alias(m)).dropna()
        out = side if out is None else out.join(side, "qid")
    return out


def significance(measured: DataFrame, base: str, measure: str = "ap") -> DataFrame:
    """(model, n, t, p): the paired t-test of each model against the base, two-sided; null where all differences are equal. A row a model."""
    x = measured.filter(F.col("model") == base).select("qid", F.round(measure, 9).alias("x"))
    d = measured.filter(F.col("model") != base).select("model", "qid", F.round(measure, 9).alias("y")).join(x, "qid").dropna().withColumn("d", F.col("y") - F.col("x"))
    spread = F.stddev_samp("d")
    rows = d.groupBy("model").agg(F.count("d").alias("n"), F.when(spread > 0, F.avg("d") / (spread / F.sqrt(F.count("d").cast("double")))).alias("t"))
    return rows.withColumn("p", _two_sided("t", F.col("n") - 1))


@F.pandas_udf(DoubleType())
def _two_sided(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else student_tail(a, int(n)) for a, n in zip(t, freedom)], dtype="float64")


def student_tail(t: float, freedom: int) -> float:
    """The probability that |T| of Student's distribution is t or more: a sum for whole degrees of freedom (Abramowitz and Stegun, 26.7.3-4)."""
    angle = math.atan2(abs(t), math.sqrt(freedom))
    cos2, term, total = math.cos(angle) ** 2, 1.0, 0.0
    if freedom % 2:
        term = math.cos(angle)
        for k in range(3, freedom + 1, 2):
            total += term
            term *= cos2 * (k - 1) / k
        return max(0.0, 1 - 2 / math.pi * (angle + math.sin(angle) * total))
    for k in range(2, freedom + 1, 2):
        total += term
        term *= cos2 * (k - 1) / k
    return max(0.0, 1 - math.sin(angle) * total)


def by_query(df: DataFrame, *then) -> DataFrame:
    """Rows in the order of qid, numbers first and as numbers, then by further columns."""
    return df.orderBy(F.expr("try_cast(qid AS decimal(38, 0))").asc_nulls_last(), "qid", *then)
