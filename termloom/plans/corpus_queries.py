"""Queries on tokens, corpus statistics, vocabulary laws and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import stem
from termloom.functions import text as tx
from termloom.operators import corpus, ranks
from termloom.plans.registry import STOP_SQL, TERMS, TF, TOK, VALID, fold, is_valid, query, words
from termloom.session import materialize

BLANK = r"[ \t\n\x0b\f\r]"


def listed(array):
    """An array as text, for a stable comparison."""
    return F.array_join(array, "|")


@query("q_ascii_fold", f"SELECT doc_id, {fold('text')} AS folded FROM documents")
def ascii_fold(t):
    return t("documents").select("doc_id", tx.ascii_fold(F.col("text")).alias("folded"))


@query(
    "q_tokens_split",
    f"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({fold(r"lower(regexp_replace(text, '[^\pL\pM\pN\s]|_', '', 'g'))")}, '\\s+'), lambda x: x <> ''), '|') AS tokens FROM documents""",
)
def tokens_split(t):
    return t("documents").select("doc_id", listed(tx.tokens_split(F.col("text"))).alias("tokens"))


@query("q_tokens_words", f"SELECT doc_id, array_to_string({words('text')}, '|') AS tokens FROM documents")
def tokens_words(t):
    return t("documents").select("doc_id", listed(tx.tokens_words(F.col("text"))).alias("tokens"))


@query("q_tokens_trec", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+(?:[-''][a-z]+)*'), '|') AS tokens FROM documents")
def tokens_trec(t):
    return t("documents").select("doc_id", listed(tx.tokens_trec(F.col("text"))).alias("tokens"))


@query("q_tokens_typed")
def tokens_typed(t):
    """(doc_id, ty, tok, n): SQL has no lookahead; the tests compare with a sequential rendering."""
    return t("documents").select("doc_id", F.explode(tx.tokens_typed(F.col("text"))).alias("x")).groupBy("doc_id", "x.ty", "x.tok").agg(F.count("*").alias("n"))


@query(
    "q_clean_query",
    f"SELECT item_id AS qid, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL})), ' ') AS query FROM benchmark",
)
def clean_query(t):
    return t("benchmark").select(F.col("item_id").alias("qid"), tx.clean_query(F.col("text"), corpus.STOP).alias("query"))


@query("q_langid_clean", f"SELECT doc_id, regexp_replace(lower(text), '[^{tx.ALPHABET}]', '', 'g') AS letters FROM documents")
def langid_clean(t):
    return t("documents").select("doc_id", tx.letters_only(F.col("text")).alias("letters"))


@query("q_tf", f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def tf(t):
    return corpus.term_frequency(corpus.valid(corpus.tokens(t("documents"))))


@query("q_term_df", f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def term_df(t):
    return tf(t).groupBy("term").agg(F.count("*").alias("df"))


@query("q_term_stats", f"WITH {TERMS} SELECT term, cf, df FROM terms")
def term_stats(t):
    return corpus.term_stats(corpus.valid(corpus.tokens(t("documents"))))


@query("q_term_stats_snowball")
def term_stats_snowball(t):
    """Terms stemmed by the Spanish Snowball rules before validity is tested; only distinct terms are stemmed."""
    counted = corpus.term_frequency(corpus.tokens(t("documents")))
    stems = counted.select("term").distinct().select("term", stem.spanish(F.col("term")).alias("stem"))
    by_stem = counted.join(stems, "term").groupBy("doc_id", "stem").agg(F.sum("tf").alias("tf"))
    by_stem = by_stem.filter(tx.is_valid_term(F.col("stem"), corpus.STOP))
    return by_stem.groupBy("stem").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


@query("q_stem_compare")
def stem_compare(t):
    """One row: distinct words and stems of two English stemmers, and on how many words they agree."""
    distinct = t("documents").select(F.explode(tx.tokens_trec(F.col("text"))).alias("term")).distinct()
    both = distinct.select("term", stem.porter(F.col("term")).alias("p"), stem.lancaster(F.col("term")).alias("l"))
    out = both.agg(F.count("*").alias("n_words"), F.count_distinct("p").alias("porter_stems"), F.count_distinct("l").alias("lancaster_stems"), F.count_if(F.col("p") == F.col("l")).alias("n_equal"))
    return out.withColumn("n_different", F.col("n_words") - F.col("n_equal")).withColumn("pct_equal", F.round(100 * F.col("n_equal") / F.col("n_words"), 6))


@query(
    "q_corpus_totals",
    f"WITH {TERMS} SELECT (SELECT count(*) FROM documents) AS n_docs, CAST(coalesce(sum(cf), 0) AS BIGINT) AS n_tokens, count(*) AS n_terms FROM terms",
)
def corpus_totals(t):
    return term_stats(t).agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_terms")).crossJoin(t("documents").agg(F.count("*").alias("n_docs")))


@query(
    "q_corpus_stats",
    f"""WITH {TERMS},
sizes AS (SELECT d.doc_id, len({words('text')}) AS n, len(list_filter({words('text')}, lambda x: {is_valid('x')})) AS v FROM documents d),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avg_tokens, round(avg(v), 6) AS avg_terms FROM sizes),
g AS (SELECT count(*) AS n_terms, round(avg(length(term)), 6) AS avg_length, count(*) FILTER (WHERE cf = 1) AS hapax FROM terms),
lo AS (SELECT n AS min_tokens, v AS min_terms FROM sizes ORDER BY n, doc_id LIMIT 1),
hi AS (SELECT n AS max_tokens, v AS max_terms FROM sizes ORDER BY n DESC, doc_id LIMIT 1)
SELECT n_docs, n_tokens, n_terms, avg_tokens, avg_terms, avg_length, min_tokens, min_terms, max_tokens, max_terms, hapax FROM s, g, lo, hi""",
)
def corpus_stats(t):
    return corpus.corpus_statistics(t("documents"))


@query(
    "q_df_compare",
    f"""WITH {TERMS}, {TOK.replace('tok AS', 'ctok AS').replace('FROM documents', 'FROM conversations').replace('doc_id AS doc_id', 'conv_id AS doc_id')},
other AS (SELECT term, count(DISTINCT doc_id) AS df FROM ctok WHERE {is_valid()} GROUP BY term)
SELECT count(*) AS n_terms, count(*) FILTER (WHERE o.df = coalesce(t.df, 0)) AS n_equal, count(*) FILTER (WHERE t.df IS NULL) AS n_missing FROM other o LEFT JOIN terms t USING (term)""",
)
def df_compare(t):
    """The document frequencies of conversations, as expected ones, against those of documents."""
    other = corpus.term_stats(corpus.valid(corpus.tokens(t("conversations").select(F.col("conv_id").alias("doc_id"), "text")))).select("term", F.col("df").alias("expected"))
    both = other.join(term_df(t), "term", "left")
    return both.agg(F.count("*").alias("n_terms"), F.count_if(F.col("expected") == F.coalesce("df", F.lit(0))).alias("n_equal"), F.count_if(F.col("df").isNull()).alias("n_missing"))


@query("q_top_terms", f"WITH {TERMS} SELECT term, cf FROM terms ORDER BY cf DESC, term LIMIT 10")
def top_terms(t):
    return term_stats(t).select("term", "cf").orderBy(F.desc("cf"), "term").limit(10)


@query("q_bottom_terms", f"WITH {TERMS} SELECT term, cf FROM terms ORDER BY cf, term DESC LIMIT 10")
def bottom_terms(t):
    return term_stats(t).select("term", "cf").orderBy("cf", F.desc("term")).limit(10)


ZIPF = f"""{TOK}, zterms AS (SELECT term, count(*) AS cf FROM tok WHERE length(term) BETWEEN 2 AND 30 GROUP BY term),
ranked AS (SELECT row_number() OVER (ORDER BY cf DESC, term) AS rank, term, cf FROM zterms)"""
CUTS = """cuts AS (SELECT p, q, CAST(floor(v * p + 1e-9) AS BIGINT) AS k, CAST(floor(v * q + 1e-9) AS BIGINT) AS j, total, f1
  FROM (VALUES (0.1::DOUBLE, 0.0::DOUBLE), (0.2::DOUBLE, 0.1::DOUBLE), (0.3::DOUBLE, 0.2::DOUBLE)) x(p, q),
       (SELECT count(*) AS v, sum(cf) AS total, max(cf) AS f1 FROM ranked))"""


@query("q_zipf_rank", f"WITH {ZIPF} SELECT rank, term, cf FROM ranked")
def zipf_rank(t):
    return corpus.zipf_ranks(t("documents"))


@query("q_zipf_fit", f"WITH {ZIPF} SELECT round(regr_slope(log2(cf), log2(rank)), 6) AS slope, round(regr_intercept(log2(cf), log2(rank)), 6) AS intercept, round(regr_r2(log2(cf), log2(rank)), 6) AS r2 FROM ranked")
def zipf_fit(t):
    return corpus.zipf_fit(zipf_rank(t))


@query(
    "q_zipf_coverage",
    f"""WITH {ZIPF}, {CUTS}
SELECT p, k, CAST(sum(cf) AS BIGINT) AS observed, round(sum(f1 / rank::DOUBLE), 4) AS expected, round(100 * sum(cf)::DOUBLE / any_value(total), 6) AS pct_observed,
       round(abs(sum(cf)::DOUBLE - sum(f1 / rank::DOUBLE)), 4) AS difference
FROM ranked, cuts WHERE rank <= k GROUP BY p, k""",
)
def zipf_coverage(t):
    return corpus.zipf_coverage(materialize(zipf_rank(t), "zipf"))


@query(
    "q_zipf_prune",
    f"""WITH {ZIPF}, {CUTS}
SELECT p, k, count(*) FILTER (WHERE s) AS stop_in_top, count(*) FILTER (WHERE NOT s) AS others, count(*) FILTER (WHERE NOT s AND rank > j) AS new_others,
       round(100 * count(*) FILTER (WHERE s)::DOUBLE / k, 6) AS pct_stop
FROM (SELECT *, term IN ({STOP_SQL}) AS s FROM ranked), cuts WHERE rank <= k GROUP BY p, k""",
)
def zipf_prune(t):
    return corpus.zipf_prune(materialize(zipf_rank(t), "zipf"))


HEAPS = f"""{TOK}, ht AS (SELECT term, row_number() OVER (ORDER BY doc_id, pos) AS n, row_number() OVER (PARTITION BY term ORDER BY doc_id, pos) AS k FROM tok WHERE length(term) BETWEEN 2 AND 30),
curve AS (SELECT n, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS BIGINT) AS v FROM ht)"""


@query("q_heaps_curve", f"WITH {HEAPS} SELECT n, v FROM curve")
def heaps_curve(t):
    return corpus.heaps_curve(t("documents"))


@query("q_heaps_fit_loglog", f"WITH {HEAPS} SELECT round(exp(regr_intercept(ln(v), ln(n))), 4) AS k, round(regr_slope(ln(v), ln(n)), 6) AS beta, round(regr_r2(ln(v), ln(n)), 6) AS r2 FROM curve")
def heaps_fit_loglog(t):
    return corpus.heaps_fit_loglog(heaps_curve(t))


@query("q_heaps_fit")
def heaps_fit(t):
    return corpus.heaps_fit(corpus.heaps_documents(t("documents")))


@query(
    "q_heaps_grid",
    f"WITH {HEAPS} SELECT k, beta, n, round(k * pow(n::DOUBLE, beta), 4) AS v FROM range(30, 101, 10) g(k), (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) b(beta), (SELECT max(n) AS n FROM curve)",
)
def heaps_grid(t):
    return corpus.heaps_grid(heaps_curve(t))


LETTERS = ", ".join(f"('{c}')" for c in tx.ALPHABET)
LANG = f"""texts AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^{tx.ALPHABET}]', '', 'g') AS s FROM documents),
letters AS (SELECT * FROM (VALUES {LETTERS}) l(c)), langs AS (SELECT DISTINCT lang FROM documents)"""
BIGRAM = f"""{LANG}, got AS (SELECT lang, doc_id, substr(s, i, 2) AS b FROM (SELECT lang, doc_id, s, unnest(range(1, length(s))) AS i FROM texts)),
bc AS (SELECT lang, b, count(*) AS n FROM got GROUP BY ALL), bx AS (SELECT lang, substr(b, 1, 1) AS x, sum(n) AS t FROM bc GROUP BY ALL),
model AS (SELECT l.lang, x.c AS x, y.c AS y, (coalesce(bc.n, 0) + 1) / (coalesce(bx.t, 0) + 49)::DOUBLE AS p FROM langs l, letters x, letters y
  LEFT JOIN bc ON bc.lang = l.lang AND bc.b = x.c || y.c LEFT JOIN bx ON bx.lang = l.lang AND bx.x = x.c)"""
PREDICTED = f"""{BIGRAM}, scored AS (SELECT g.doc_id, g.lang, m.lang AS guess, sum(g.n * ln(m.p)) AS score
  FROM (SELECT doc_id, lang, b, count(*) AS n FROM got GROUP BY ALL) g JOIN model m ON g.b = m.x || m.y GROUP BY ALL),
predicted AS (SELECT doc_id, lang, guess AS predicted, round(score, 4) AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, list_position(['en', 'fr', 'es', 'de'], guess)) = 1)"""


@query(
    "q_langid_unigram_model",
    f"""WITH {LANG}, cs AS (SELECT lang, unnest(string_split(s, '')) AS c FROM texts WHERE s <> ''), cc AS (SELECT lang, c, count(*) AS n FROM cs GROUP BY ALL),
ct AS (SELECT lang, sum(n) AS t FROM cc GROUP BY lang)
SELECT l.lang, x.c, round((coalesce(cc.n, 0) + 1) / (coalesce(ct.t, 0) + 49)::DOUBLE, 10) AS p FROM langs l CROSS JOIN letters x LEFT JOIN cc ON cc.lang = l.lang AND cc.c = x.c LEFT JOIN ct ON ct.lang = l.lang""",
)
def langid_unigram_model(t):
    return corpus.unigram_model(corpus.language_texts(t("documents"))).withColumn("p", F.round("p", 10))


@query("q_langid_bigram_model", f"WITH {BIGRAM} SELECT lang, x, y, round(p, 10) AS p FROM model")
def langid_bigram_model(t):
    return corpus.bigram_model(corpus.language_texts(t("documents"))).withColumn("p", F.round("p", 10))


@query("q_langid_predict", f"WITH {PREDICTED} SELECT doc_id, lang, predicted, score FROM predicted")
def langid_predict(t):
    """Models of all documents, applied to all documents."""
    texts = corpus.language_texts(t("documents"))
    return corpus.predict_language(texts, corpus.bigram_model(texts))


@query("q_langid_confusion", f"WITH {PREDICTED} SELECT lang, predicted, count(*) AS n, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM predicted GROUP BY lang, predicted")
def langid_confusion(t):
    counts = langid_predict(t).groupBy("lang", "predicted").agg(F.count("*").alias("n"))
    counts = materialize(counts, "confusion")
    return counts.crossJoin(counts.agg(F.sum("n").alias("t"))).select("lang", "predicted", "n", F.round(100 * F.col("n") / F.col("t"), 6).alias("pct"))


BY_LETTER = f"""{LANG}, cs AS (SELECT doc_id, lang, unnest(string_split(s, '')) AS c FROM texts WHERE s <> ''), cc AS (SELECT lang, c, count(*) AS n FROM cs GROUP BY ALL),
ct AS (SELECT lang, sum(n) AS t FROM cc GROUP BY lang),
model AS (SELECT l.lang, x.c, (coalesce(cc.n, 0) + 1) / (coalesce(ct.t, 0) + 49)::DOUBLE AS p FROM langs l CROSS JOIN letters x LEFT JOIN cc ON cc.lang = l.lang AND cc.c = x.c LEFT JOIN ct ON ct.lang = l.lang),
scored AS (SELECT g.doc_id, g.lang, m.lang AS guess, sum(g.n * ln(m.p)) AS score FROM (SELECT doc_id, lang, c, count(*) AS n FROM cs GROUP BY ALL) g JOIN model m ON g.c = m.c GROUP BY ALL),
predicted AS (SELECT doc_id, lang, guess AS predicted, round(score, 4) AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, list_position(['en', 'fr', 'es', 'de'], guess)) = 1)"""


@query("q_langid_predict_letters", f"WITH {BY_LETTER} SELECT doc_id, lang, predicted, score FROM predicted")
def langid_predict_letters(t):
    """The same by single letters."""
    texts = corpus.language_texts(t("documents"))
    return corpus.predict_by_letters(texts, corpus.unigram_model(texts))


@query("q_langid_confusion_letters", f"WITH {BY_LETTER} SELECT lang, predicted, count(*) AS n, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM predicted GROUP BY lang, predicted")
def langid_confusion_letters(t):
    counts = materialize(langid_predict_letters(t).groupBy("lang", "predicted").agg(F.count("*").alias("n")), "confusion")
    return counts.crossJoin(counts.agg(F.sum("n").alias("t"))).select("lang", "predicted", "n", F.round(100 * F.col("n") / F.col("t"), 6).alias("pct"))


@query("q_term_stats_typed")
def term_stats_typed(t):
    """Frequencies of the valid tokens of the typed tokenizer."""
    return corpus.term_stats(corpus.typed_terms(t("documents")))
