"""Corpus statistics, vocabulary laws and language identification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.operators import ranks
from termloom.session import materialize, release

STOP = tx.stop_words("english") + tx.stop_words("spanish")


def tokens(docs: DataFrame, tokenizer=tx.tokens_words) -> DataFrame:
    """(doc_id, pos, term): one row a token."""
    return docs.select("doc_id", F.posexplode(tokenizer(F.col("text"))).alias("pos", "term"))


def valid(tok: DataFrame, low: int = 2, high: int = 25, stop=STOP) -> DataFrame:
    return tok.filter(tx.is_valid_term(F.col("term"), stop, low, high))


def typed_terms(docs: DataFrame, low: int = 2, high: int = 25, stop=STOP) -> DataFrame:
    """(doc_id, pos, term): valid tokens of the typed tokenizer, as an analyzer of an index."""
    tok = docs.select("doc_id", F.posexplode(tx.tokens_typed(F.col("text"))).alias("pos", "t")).select("doc_id", "pos", F.col("t.tok").alias("term"), F.col("t.ty").alias("ty"))
    return tok.filter(tx.is_valid_typed(F.col("term"), F.col("ty"), stop, low, high)).drop("ty")


def stemmed_terms(stemmer, tokenizer=tx.tokens_words, low: int = 2, high: int = 25, stop=STOP):
    """An analyzer that stems valid tokens by a function of a column; each distinct word is stemmed once and joined back."""

    def analyze(docs: DataFrame) -> DataFrame:
        tok = valid(tokens(docs, tokenizer), low, high, stop)
        stems = tok.select("term").distinct().select(F.col("term").alias("word"), stemmer(F.col("term")).alias("stem"))
        return tok.join(stems, F.col("term") == F.col("word")).select("doc_id", "pos", F.col("stem").alias("term"))

    return analyze


def term_frequency(tok: DataFrame) -> DataFrame:
    """(doc_id, term, tf)"""
    return tok.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(tok: DataFrame) -> DataFrame:
    """(term, cf, df): occurrences, and documents with the term."""
    return term_frequency(tok).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: sizes, means, the shortest and the longest document by raw tokens (the lowest doc_id of several), hapax terms."""
    words = tx.tokens_words(F.col("text"))
    sizes = docs.select("doc_id", F.coalesce(F.size(words), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.size(F.filter(words, lambda x: tx.is_valid_term(x, STOP))), F.lit(0)).cast("bigint").alias("v"))
    low, high = F.min_by(F.struct("n", "v"), F.struct("n", "doc_id")), F.min_by(F.struct("n", "v"), F.struct((-F.col("n")).alias("m"), "doc_id"))
    per_doc = sizes.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.avg("n").alias("avg_tokens"), F.avg("v").alias("avg_terms"), low.alias("lo"), high.alias("hi"))
    per_term = term_stats(valid(tokens(docs))).agg(F.count("*").alias("n_terms"), F.avg(F.length("term")).alias("avg_length"), F.count_if(F.col("cf") == 1).alias("hapax"))
    return per_doc.crossJoin(F.broadcast(per_term)).select(
        "n_docs", "n_tokens", "n_terms", F.round("avg_tokens", 6).alias("avg_tokens"), F.round("avg_terms", 6).alias("avg_terms"), F.round("avg_length", 6).alias("avg_length"),
        F.col("lo.n").alias("min_tokens"), F.col("lo.v").alias("min_terms"), F.col("hi.n").alias("max_tokens"), F.col("hi.v").alias("max_terms"), "hapax",
    )


def zipf_ranks(docs: DataFrame) -> DataFrame:
    """(rank, term, cf) of terms of 2 to 30 letters; equal counts by term."""
    terms = tokens(docs).filter(F.length("term").between(2, 30)).groupBy("term").agg(F.count("*").alias("cf"))
    return ranks.by_frequency(terms).select("rank", "term", "cf")


def zipf_fit(ranked: DataFrame) -> DataFrame:
    """Least squares of log2 cf on log2 rank."""
    x, y = F.log2("rank"), F.log2("cf")
    return ranked.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def zipf_coverage(ranked: DataFrame, shares=(0.1, 0.2, 0.3)) -> DataFrame:
    """Occurrences of the top share of the vocabulary, and those that f1 / rank expects."""
    whole = ranked.agg(F.count("*").alias("v"), F.sum("cf").alias("total"), F.max("cf").alias("f1"))
    cuts = ranked.sparkSession.createDataFrame([(p,) for p in shares], "p double").crossJoin(F.broadcast(whole)).withColumn("k", F.floor(F.col("v") * F.col("p") + 1e-9))
    hit = F.col("rank") <= F.col("k")
    out = ranked.crossJoin(F.broadcast(cuts)).groupBy("p", "k", "total").agg(F.sum(F.when(hit, F.col("cf"))).alias("observed"), F.sum(F.when(hit, F.col("f1") / F.col("rank"))).alias("expected"))
    return out.select("p", "k", F.col("observed"), F.round("expected", 4).alias("expected"), F.round(100 * F.col("observed") / F.col("total"), 6).alias("pct_observed"), F.round(F.abs(F.col("observed") - F.col("expected")), 4).alias("difference"))


def zipf_prune(ranked: DataFrame, stop=STOP, shares=(0.1, 0.2, 0.3)) -> DataFrame:
    """How much of the stopword list the top share holds, and how many other terms would be pruned with it."""
    v = ranked.agg(F.count("*").alias("v"))
    cuts = ranked.sparkSession.createDataFrame([(p, max([0.0, *[q for q in shares if q < p]])) for p in shares], "p double, q double").crossJoin(F.broadcast(v))
    cuts = cuts.select("p", F.floor(F.col("v") * F.col("p") + 1e-9).alias("k"), F.floor(F.col("v") * F.col("q") + 1e-9).alias("j"))
    top, word = F.col("rank") <= F.col("k"), F.col("term").isin(*stop)
    out = ranked.crossJoin(F.broadcast(cuts)).groupBy("p", "k").agg(
        F.count_if(top & word).alias("stop_in_top"), F.count_if(top & ~word).alias("others"), F.count_if(top & ~word & (F.col("rank") > F.col("j"))).alias("new_others")
    )
    return out.withColumn("pct_stop", F.when(F.col("k") > 0, F.round(100 * F.col("stop_in_top") / F.col("k"), 6)))


def heaps_documents(docs: DataFrame) -> DataFrame:
    """(n0, m, v0, new) of each document, in the order of doc_id: tokens before it and its own, distinct terms before it, and where it has a term that none before has.

    The curve has a point for each token; only a number for each distinct term, and for each document, is sent.
    """
    words = F.filter(tx.tokens_words(F.col("text")), lambda x: F.length(x).between(2, 30))
    first = docs.select("doc_id", F.posexplode(words).alias("pos", "term")).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    new = first.groupBy(F.col("f.doc_id").alias("doc_id")).agg(F.array_sort(F.collect_list("f.pos")).alias("new"))
    sizes = docs.select("doc_id", F.coalesce(F.size(words), F.lit(0)).cast("bigint").alias("m")).groupBy("doc_id").agg(F.sum("m").alias("m"))
    rows = materialize(sizes.join(new, "doc_id", "left").select("doc_id", "m", F.coalesce("new", F.array().cast("array<int>")).alias("new")), "documents")
    counts = rows.select("doc_id", "m", F.size("new").cast("bigint").alias("k"))
    n = ranks.running(counts, "m", "doc_id", ["doc_id"], "n").select("doc_id", (F.col("n") - F.col("m")).alias("n0"))
    v = ranks.running(counts, "k", "doc_id", ["doc_id"], "v").select("doc_id", (F.col("v") - F.col("k")).alias("v0"))
    return rows.join(n, "doc_id").join(v, "doc_id").select("n0", "m", "v0", "new")


#: Points of the curve that a task makes at once.
POINTS_AT_ONCE = 1 << 20


def _points(batches):
    """n and v of runs of rows of heaps_documents()."""
    for batch in batches:
        n0, m, v0 = (batch.column(c).to_numpy() for c in ("n0", "m", "v0"))
        run = np.concatenate(([0], np.cumsum(m)))[:-1] // POINTS_AT_ONCE
        cuts = np.flatnonzero(np.diff(run, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(m)]):
            size, lists = m[i:j], batch.column("new").slice(i, j - i)
            starts = np.concatenate(([0], np.cumsum(size)))
            fresh = np.zeros(starts[-1] + 1, dtype=np.int64)
            fresh[np.repeat(starts[:-1], lists.value_lengths().to_numpy()) + lists.flatten().to_numpy() + 1] = 1
            fresh = np.cumsum(fresh)
            yield np.arange(1, starts[-1] + 1) + np.repeat(n0[i:j] - starts[:-1], size), fresh[1:] + np.repeat(v0[i:j] - fresh[starts[:-1]], size)


def heaps_curve(docs: DataFrame) -> DataFrame:
    """(n, v): distinct terms among the first n valid tokens, in the order of doc_id and position."""

    def run(batches):
        for n, v in _points(batches):
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})

    return heaps_documents(docs).mapInArrow(run, "n long, v long")


def heaps_fit_loglog(curve: DataFrame) -> DataFrame:
    x, y = F.log("n"), F.log("v")
    return curve.agg(F.round(F.exp(F.regr_intercept(y, x)), 4).alias("k"), F.round(F.regr_slope(y, x), 6).alias("beta"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def heaps_fit(documents: DataFrame, k: float = 50.0, beta: float = 0.5, steps: int = 30) -> DataFrame:
    """Least squares of V = k n^beta over the curve of heaps_documents() by Gauss-Newton; each step is one pass of five sums, over points that are made in passing."""
    spark, documents = documents.sparkSession, materialize(documents, "curve")

    def sums(of) -> list[float]:
        """Sums over the curve of the arrays that a function makes of n and v; the first is the number of points."""

        def run(batches):
            total = 0
            for n, v in _points(batches):
                n, v = n.astype(float), v.astype(float)
                total = total + np.array([len(n), *[x.sum() for x in of(n, v)]])
            if np.ndim(total):
                yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

        got = [r["s"] for r in documents.mapInArrow(run, "s array<double>").collect()]
        return [math.fsum(x) for x in zip(*got)]

    def gauss_newton(k, beta):
        def of(n, v):
            p, log = n**beta, np.log(n)
            g, r = p * k * log, v - p * k
            return p * p, p * g, g * g, p * r, g * r

        return sums(of)

    for _ in range(steps):
        found = gauss_newton(k, beta)
        if not found or not found[0]:
            break
        _, a, b, d, e, f = found
        det = a * d - b * b
        if not det:
            break
        dk, db = (d * e - b * f) / det, (a * f - b * e) / det
        k, beta = k + dk, beta + db
        if abs(dk) < 1e-9 * abs(k) and abs(db) < 1e-12:
            break
    whole, r2 = sums(lambda n, v: (v,)), None
    if whole and whole[0]:
        mean = whole[1] / whole[0]
        _, res, spread = sums(lambda n, v: ((v - k * n**beta) ** 2, (v - mean) ** 2))
        r2 = 1 - res / spread if spread else None
    release(documents)
    return spark.createDataFrame([(float(k), float(beta), r2)], "k double, beta double, r2 double").select(*[F.round(c, 6).alias(c) for c in ("k", "beta", "r2")])


def heaps_grid(curve: DataFrame) -> DataFrame:
    """Theoretical sizes at the curve's end for K = 30..100 and three betas."""
    spark = curve.sparkSession
    grid = spark.range(30, 101, 10).select(F.col("id").alias("k")).crossJoin(spark.createDataFrame([(0.4,), (0.5,), (0.6,)], "beta double"))
    return grid.crossJoin(F.broadcast(curve.agg(F.max("n").alias("n")))).select("k", "beta", "n", F.round(F.col("k") * F.pow(F.col("n").cast("double"), F.col("beta")), 4).alias("v"))


# Language identification


def language_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, s): all documents, as runs of the alphabet's letters."""
    return docs.select("doc_id", "lang", tx.letters_only(F.col("text")).alias("s"))


#: Letters that are counted at once in a task.
LETTERS_AT_ONCE = 1 << 20
_CODES = np.full(max(map(ord, tx.ALPHABET)) + 1, 0)
_CODES[[ord(c) for c in tx.ALPHABET]] = np.arange(len(tx.ALPHABET))


def _grams(batches, order: int):
    """For runs of rows of (.., s): the rows, codes of all their letters (order 1) or neighbouring letters (2), and how many each row has."""
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch.column("s")), 0).to_numpy()
        run = np.concatenate(([0], np.cumsum(size)))[:-1] // LETTERS_AT_ONCE
        cuts = np.flatnonzero(np.diff(run, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(size)]):
            rows, n = batch.slice(i, j - i), size[i:j]
            codes = _CODES[np.frombuffer("".join(x or "" for x in rows.column("s").to_pylist()).encode("utf-32-le"), np.uint32)]
            if order == 2:
                first = np.ones(len(codes), dtype=bool)
                first[np.cumsum(n)[n > 0] - 1] = False  # the last letter of a text precedes nothing
                first = np.flatnonzero(first)
                codes, n = codes[first] * len(tx.ALPHABET) + codes[first + 1], np.maximum(n - 1, 0)
            yield rows, codes, n


def _gram_counts(train: DataFrame, order: int) -> DataFrame:
    """(lang, g, n): counts of letters or neighbouring letters by their codes; a task sends one row for each that it met."""

    def run(batches):
        held = {}
        for rows, codes, n in _grams(batches, order):
            langs = rows.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), n)
                held[lang] = held.get(lang, 0) + np.bincount(codes[mine], minlength=len(tx.ALPHABET) ** order)
        for lang, counts in held.items():
            g = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g, pa.int64()), "n": pa.array(counts[g], pa.int64())})

    counts = train.select("lang", "s").mapInArrow(run, "lang string, g long, n long")
    return counts.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _letter(code: Column) -> Column:
    return F.substring(F.lit(tx.ALPHABET), (code + 1).cast("int"), F.lit(1))


def _alphabet(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in tx.ALPHABET], "c string")


def unigram_model(train: DataFrame) -> DataFrame:
    """(lang, c, p): Laplace-smoothed probabilities of all letters of the alphabet."""
    got = materialize(_gram_counts(train, 1).select("lang", _letter(F.col("g")).alias("c"), "n"), "letters")
    grid = train.select("lang").distinct().crossJoin(F.broadcast(_alphabet(train)))
    total = got.groupBy("lang").agg(F.sum("n").alias("t"))
    size = len(tx.ALPHABET)
    return grid.join(got, ["lang", "c"], "left").join(total, "lang", "left").select("lang", "c", ((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + size)).alias("p"))


def bigram_model(train: DataFrame) -> DataFrame:
    """(lang, x, y, p): probabilities of y after x; the last letter of a text precedes nothing."""
    size = len(tx.ALPHABET)
    got = _gram_counts(train, 2).select("lang", _letter(F.floor(F.col("g") / size)).alias("x"), _letter(F.col("g") % size).alias("y"), "n")
    got = materialize(got, "pairs")
    letters = _alphabet(train)
    grid = train.select("lang").distinct().crossJoin(F.broadcast(letters.withColumnRenamed("c", "x"))).crossJoin(F.broadcast(letters.withColumnRenamed("c", "y")))
    rows = got.groupBy("lang", "x").agg(F.sum("n").alias("t"))
    return grid.join(got, ["lang", "x", "y"], "left").join(rows, ["lang", "x"], "left").select("lang", "x", "y", ((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + size)).alias("p"))


LANGS = ("en", "fr", "es", "de")


def predict_by_letters(test: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, predicted, score): the language with the largest sum of logs over single letters; ties in the order of LANGS."""
    return _likeliest(test, model.select("lang", F.col("c").alias("gram"), F.log("p").alias("lp")), 1)


def predict_language(test: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, predicted, score): the language with the largest sum of logs over bigrams; ties in the order of LANGS."""
    return _likeliest(test, model.select("lang", F.concat("x", "y").alias("gram"), F.log("p").alias("lp")), 2)


def _likeliest(test: DataFrame, logs: DataFrame, order: int) -> DataFrame:
    """Texts are scored where they are read; the model logs(lang, gram, lp) has a fixed number of rows a language and is sent to all tasks."""
    place, tables = {c: i for i, c in enumerate(tx.ALPHABET)}, {}
    for lang, gram, lp in logs.collect():
        tables.setdefault(lang, np.zeros(len(place) ** order))[sum(place[c] * len(place) ** k for k, c in enumerate(reversed(gram)))] = lp

    def run(batches):
        for rows, codes, n in _grams(batches, order):
            has = np.flatnonzero(n)
            if len(has):
                own, starts = rows.take(pa.array(has)), np.concatenate(([0], np.cumsum(n[has])))[:-1]
                for guess, table in tables.items():
                    score = pa.array(np.add.reduceat(table[codes], starts))
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("lang"), pa.array([guess] * len(has), pa.string()), score], names=["doc_id", "lang", "guess", "score"])

    kind = test.schema["doc_id"].dataType.simpleString()
    scored = test.select("doc_id", "lang", "s").mapInArrow(run, f"doc_id {kind}, lang string, guess string, score double")
    scored = scored.groupBy("doc_id", "lang", "guess").agg(F.sum("score").alias("score"))
    best = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("guess"))
    w = Window.partitionBy("doc_id").orderBy(F.round("score", 6).desc(), best)
    return scored.withColumn("k", F.row_number().over(w)).filter("k = 1").select("doc_id", "lang", F.col("guess").alias("predicted"), F.round("score", 4).alias("score"))
