"""Ranked retrieval: vector space and weighting models over a table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators import corpus


def query_terms(topics: DataFrame, analyzer=None) -> DataFrame:
    """(qid, term, qtf) of valid terms of topics(qid, text), or of those that an analyzer makes of (doc_id, text)."""
    texts = topics.select(F.col("qid").alias("doc_id"), "text")
    tok = analyzer(texts) if analyzer else corpus.valid(corpus.tokens(texts))
    return tok.groupBy(F.col("doc_id").alias("qid"), "term").agg(F.count("*").alias("qtf"))


def idf(tf: DataFrame, docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, df, idf): natural log of N / df over all documents. terms(term, df): counts of tf, if they are known."""
    n = docs.agg(F.count("*").alias("n"))
    counts = tf.groupBy("term").agg(F.count("*").alias("df")) if terms is None else terms
    return counts.crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def weights(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, term, w): (1 + ln tf) idf, without zeros."""
    return tf.join(idf(tf, docs), "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")).filter("w > 0")


def norms(w: DataFrame) -> DataFrame:
    return w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def top(scored: DataFrame, k: int, score: str = "score", by: tuple = ("qid",)) -> DataFrame:
    """rank from 0 by the score as reported, with six places, equal ones by doc_id, up to k a query.

    More places would let the order in which a score's terms are summed decide between equal documents.
    """
    w = Window.partitionBy(*by).orderBy(F.round(score, 6).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("bigint"))


def cosine(tf: DataFrame, docs: DataFrame, q: DataFrame, k: int = 10, terms: DataFrame | None = None) -> DataFrame:
    """(qid, rank, doc_id, score): cosine of natural tf-idf vectors with full document norms. terms(term, df): counts of tf, if they are known."""
    table = idf(tf, docs, terms)
    w = tf.join(table, "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")).filter("w > 0")
    wq = q.join(table, "term").select("qid", "term", ((1 + F.log("qtf")) * F.col("idf")).alias("wq")).filter("wq > 0")
    nq = wq.groupBy("qid").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq"))
    dots = w.join(wq, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("wq")).alias("dot"))
    scored = dots.join(norms(w), "doc_id").join(nq, "qid").select("qid", "doc_id", (F.col("dot") / (F.col("norm") * F.col("nq"))).alias("score"))
    return top(scored.filter("score > 0"), k).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def daat_cosine(tf: DataFrame, docs: DataFrame, q: DataFrame, k: int = 10) -> DataFrame:
    """Cosine over the query's dimensions alone, with decimal logs and query frequency 1.

    q(qid, pos, term): a repeated term is another dimension. Documents whose terms all have idf 0 score 0; if all idfs of a query are 0,
    it has no result. Ties by doc_id.
    """
    n = docs.agg(F.count("*").alias("n"))
    table = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log10(F.col("n") / F.col("df")).alias("idf"))
    dims = q.join(table, "term")
    nq = dims.groupBy("qid").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("nq")).filter("nq > 0")
    part = tf.join(dims, "term").withColumn("w", (1 + F.log10("tf")) * F.col("idf"))
    sums = part.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("idf")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nd"))
    scored = sums.join(nq, "qid").withColumn("score", F.when(F.col("nd") > 0, F.col("dot") / (F.col("nd") * F.col("nq"))).otherwise(0.0))
    return top(scored, k).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def statistics(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: n documents, total tokens of valid terms, avdl over documents."""
    return terms.agg(F.sum("cf").alias("total")).crossJoin(docs.agg(F.count("*").alias("n"))).select("n", "total", (F.col("total") / F.col("n")).alias("avdl"))


def tfidf(c, log2=F.log2) -> Column:
    k1, b = 1.2, 0.75
    return c("qtf") * k1 * c("tf") / (c("tf") + k1 * (1 - b + b * c("dl") / c("avdl"))) * log2(c("n") / c("df") + 1)


def bm25(c, log2=F.log2) -> Column:
    k1, b, k3 = 1.2, 0.75, 8.0
    return c("tf") * (k3 + 1) * c("qtf") / ((k3 + c("qtf")) * (k1 * (1 - b + b * c("dl") / c("avdl")) + c("tf"))) * log2((c("n") - c("df") + 0.5) / (c("df") + 0.5))


def jelinek_mercer(c, lam: float = 0.9, log2=F.log2) -> Column:
    return log2(1 + lam * c("tf") * c("total") / ((1 - lam) * c("cf") * c("dl")))


def dirichlet(c, mu: float = 2000.0, log2=F.log2) -> Column:
    return log2(1 + c("tf") * c("total") / (mu * c("cf"))) + log2(mu / (c("dl") + mu))


#: Documents that a task scores at once; of each it keeps what may be among the first k of a query and model.
SHARE = 1 << 15
MODELS = {"tfidf": tfidf, "bm25": bm25, "jm": jelinek_mercer, "dirichlet": dirichlet}


def retrieve(
    tf: DataFrame, docs: DataFrame, q: DataFrame, models: tuple[str, ...], k: int = 50, terms: DataFrame | None = None, lengths: DataFrame | None = None
) -> DataFrame:
    """(model, qid, rank, doc_id, score) for weighting models that share one pass over the matching postings.

    Postings and lengths meet once, by shares of the documents; a share is scored for all queries, whose terms are a table that is sent to all tasks.
    A row for each query, model and document would be most of all pairs of them.

    A stored index supplies terms(term, df, cf) and lengths(doc_id, dl), and tf then holds the queries' postings alone; else both are counted from tf.
    """
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")) if terms is None else terms.select("term", "df", "cf")
    dl = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl")) if lengths is None else lengths.select("doc_id", "dl")
    coll = statistics(terms, docs).first()
    asked = q.join(terms, "term").select("qid", "term", "qtf", "df", "cf").collect()
    number = {x: i for i, x in enumerate(sorted({r["term"] for r in asked}))}
    by_query: dict = {}
    for r in asked:
        by_query.setdefault(r["qid"], []).append((number[r["term"]], {"qtf": r["qtf"], "df": r["df"], "cf": r["cf"]}))
    named, place = list(by_query), {"n": coll["n"], "total": coll["total"], "avdl": coll["avdl"]}
    lists = [sorted(x, key=lambda p: p[0]) for x in by_query.values()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-coll["n"] // SHARE)))).alias("part")
    kind, qkind = tf.schema["doc_id"].dataType.simpleString(), q.schema["qid"].dataType.simpleString()

    def run(postings: pa.Table, sizes: pa.Table) -> pa.Table:
        ids, first = np.unique(sizes["doc_id"].to_numpy(), return_index=True)
        dl = sizes["dl"].to_numpy()[first]
        held = {}
        if len(ids) and postings.num_rows:
            at = np.searchsorted(ids, doc := postings["doc_id"].to_numpy())
            known = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == doc)
            t = postings["t"].to_numpy()[known]
            order = known[np.argsort(t, kind="stable")]
            t, at, tfs = postings["t"].to_numpy()[order], at[order], postings["tf"].to_numpy()[order]
            cuts = np.flatnonzero(np.diff(t, prepend=-1))
            held = {int(t[i]): (at[i:j], {"tf": tfs[i:j], "dl": dl[at[i:j]]}) for i, j in zip(cuts, [*cuts[1:], len(t)])}
        out = {c: [] for c in ("m", "q", "at", "score")}
        for i, terms_of in enumerate(lists):
            mine = [(held[t], c) for t, c in terms_of if t in held]
            if not mine:
                continue
            met = np.zeros(len(ids), dtype=bool)
            for (where, _), _ in mine:
                met[where] = True
            met = np.flatnonzero(met)
            for m, model in enumerate(models):
                score = np.zeros(len(ids))
                for (where, x), c in mine:
                    score[where] += MODELS[model]((place | c | x).__getitem__, log2=np.log2)
                found, best = score[met], met
                if len(met) > k:  # whatever may be among the first k once scores are rounded
                    enough = found >= np.partition(found, -k)[-k] - 1e-5
                    found, best = found[enough], met[enough]
                for c, x in (("m", np.full(len(best), m, np.int32)), ("q", np.full(len(best), i, np.int32)), ("at", best), ("score", found)):
                    out[c].append(x)
        m, i, at, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out.values())
        rows = [pa.array(models).take(pa.array(m, pa.int32())), pa.array(named, postings.schema.field("qid").type).take(pa.array(i, pa.int32())), pa.array(ids[at], postings.schema.field("doc_id").type), pa.array(score, pa.float64())]
        return pa.Table.from_arrays(rows, names=["model", "qid", "doc_id", "score"])

    spark = tf.sparkSession
    if not number:
        best = spark.createDataFrame([], f"model string, qid {qkind}, doc_id {kind}, score double")
    else:
        terms_of = F.broadcast(spark.createDataFrame(list(number.items()), "term string, t int"))
        matching = tf.join(terms_of, "term").filter("doc_id is not null").select(part, "doc_id", "t", "tf", F.lit(None).cast(qkind).alias("qid"))
        # another name for doc_id within the plan, as lengths that are counted from tf share its column
        sizes = dl.filter("doc_id is not null").select(part, F.col("doc_id").alias("doc_id"), "dl")
        best = matching.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(run, f"model string, qid {qkind}, doc_id {kind}, score double")
    return top(best, k, by=("model", "qid")).select("model", "qid", "rank", "doc_id", F.round("score", 6).alias("score"))
