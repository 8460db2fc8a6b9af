"""Queries on the index, Boolean and ranked retrieval, and the evaluation of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import stem
from termloom.operators import boolean, corpus, evaluate, index, rank, ranks
from termloom.plans.registry import QTERMS, TERMS, TF, is_valid, query, tokens
from termloom.session import materialize


def tf_of(t):
    """All postings of the stored index."""
    return t.index().postings().select("doc_id", "term", "tf")


#: The blocks of postings in SQL.
BLK = f"doc_id // {index.BLOCK}"


def topics(t):
    return t("benchmark").select(F.col("item_id").alias("qid"), "text")


# Index

VOCAB = f"{TERMS}, vocab AS (SELECT row_number() OVER (ORDER BY term) AS term_id, term, df, cf FROM terms)"


@query(
    "q_index_build",
    f"WITH {TF} SELECT term, {BLK} AS blk, count(*) AS df, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM tf GROUP BY ALL",
)
def index_build(t):
    """Blocks of postings, built from the texts."""
    lists = index.posting_blocks(index.term_frequencies(t("documents")))
    joined = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), ",")
    return lists.select("term", "blk", "df", joined.alias("postings"))


@query("q_index_scan", f"WITH {TF} SELECT term, doc_id, tf FROM tf")
def index_scan(t):
    """Every posting of the stored index."""
    return t.index().postings()


#: A term that inflected forms of the test language share.
LOOKUP = "Thanedble"


@query("q_posting_lookup", f"WITH {TF} SELECT tf.doc_id, coalesce(d.source, '?') AS name, tf.tf FROM tf LEFT JOIN documents d USING (doc_id) WHERE term = lower('{LOOKUP}')")
def posting_lookup(t):
    return index.lookup(t.index(), LOOKUP)


@query("q_vocab_offsets", f"WITH {VOCAB} SELECT term_id, term, df, CAST(coalesce(sum(df * 8) OVER (ORDER BY term_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seek FROM vocab")
def vocab_offsets(t):
    return t.index().vocabulary.select("term_id", "term", "df", "seek")


@query("q_df_histogram", f"WITH {TERMS} SELECT df, count(*) AS n_terms FROM terms WHERE df <= 30 GROUP BY df")
def df_histogram(t):
    return t.index().vocabulary.filter("df <= 30").groupBy("df").agg(F.count("*").alias("n_terms"))


@query(
    "q_index_overhead",
    f"""WITH {TF} SELECT bytes AS text_bytes, n * 8 AS index_bytes, n * 4 AS index_bytes_plain, round(n * 8 / bytes::DOUBLE, 6) AS ratio
FROM (SELECT count(*) AS n FROM tf), (SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents)""",
)
def index_overhead(t):
    n = t.index().vocabulary.agg(F.sum("df").alias("n"))
    return n.crossJoin(t("documents").agg(F.sum(F.octet_length("text")).alias("text_bytes"))).select(
        "text_bytes", (F.col("n") * 8).alias("index_bytes"), (F.col("n") * 4).alias("index_bytes_plain"), F.round(F.col("n") * 8 / F.col("text_bytes"), 6).alias("ratio")
    )


@query(
    "q_skip_list",
    f"""WITH {TF}, pos AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY term) AS df FROM tf)
SELECT term, doc_id, idx FROM pos WHERE df > 1 AND idx % greatest(1, CAST(floor(sqrt(df)) AS BIGINT)) = 0""",
)
def skip_list(t):
    return index.skip_list(tf_of(t))


GAPS = f"{TF}, gaps AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM tf)"


@query("q_dgaps", f"WITH {GAPS} SELECT term, doc_id, tf, gap FROM gaps")
def dgaps(t):
    return index.gap_rows(t.index().blocks)


@query("q_dgaps_inverse", f"WITH {TF} SELECT term, doc_id FROM tf")
def dgaps_inverse(t):
    return index.gap_rows_inverse(index.gap_blocks(t.index().blocks.select("term", "blk", "docs")).select("term", "blk", "gaps"))


VBYTE = """array_to_string(list_transform(range(greatest(1, CAST(ceil(length(format('{:b}', gap)) / 7.0) AS BIGINT))),
  lambda i: printf('%02x', ((gap >> (7 * i)::INT) & 127) + CASE WHEN (gap >> (7 * (i + 1))::INT) = 0 THEN 128 ELSE 0 END)), '')"""


@query("q_vbyte", f"WITH {GAPS} SELECT term, {BLK} AS blk, upper(string_agg({VBYTE}, '' ORDER BY doc_id)) AS vbyte FROM gaps GROUP BY ALL")
def vbyte(t):
    return index.compressed_blocks(t.index().blocks).select("term", "blk", F.hex("vbyte").alias("vbyte"))


@query(
    "q_gamma",
    f"""WITH {TF}, b AS (SELECT term, {BLK} AS blk, string_agg(repeat('0', length(format('{{:b}}', tf)) - 1) || format('{{:b}}', tf), '' ORDER BY doc_id) AS bits FROM tf GROUP BY ALL)
SELECT term, blk, rpad(bits, CAST(ceil(length(bits) / 8.0) * 8 AS INT), '0') AS gamma FROM b""",
)
def gamma(t):
    """The padded bits; hexadecimal digits are turned back into them."""
    digits = F.split(F.hex("gamma"), "")
    bits = F.array_join(F.transform(F.filter(digits, lambda x: x != ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    return index.compressed_blocks(t.index().blocks).select("term", "blk", bits.alias("gamma"))


@query(
    "q_compress_sizes",
    f"""WITH {GAPS}, per AS (SELECT term, sum(CAST(ceil(length(format('{{:b}}', gap)) / 7.0) AS BIGINT)) AS v, CAST(ceil(sum(2 * length(format('{{:b}}', tf)) - 1) / 8.0) AS BIGINT) AS g, count(*) AS n FROM gaps GROUP BY term, {BLK})
SELECT CAST(sum(v) AS BIGINT) AS vbyte_bytes, CAST(sum(g) AS BIGINT) AS gamma_bytes, CAST(sum(n) AS BIGINT) AS postings, round((sum(v) + sum(g))::DOUBLE / (8 * sum(n)), 6) AS ratio FROM per""",
)
def compress_sizes(t):
    return index.sizes_of(index.compressed_blocks(t.index().blocks))


@query("q_codec_roundtrip", f"WITH {TF} SELECT term, doc_id, tf FROM tf")
def codec_roundtrip(t):
    """Postings after compression and decompression: equal to those before."""
    return index.decompress(index.compressed_blocks(t.index().blocks))


# Boolean queries: a log of each topic's first two and first three distinct valid terms

LOG = f"""{tokens('qtok', 'benchmark', 'item_id', 'qid')}, firsts AS (SELECT qid, term, min(pos) AS first_pos FROM qtok WHERE {is_valid()} GROUP BY ALL),
numbered AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY first_pos) AS i, count(*) OVER (PARTITION BY qid) AS n FROM firsts),
log AS (SELECT qid || '-' || k AS qid, CAST(i AS INT) AS i, term, k FROM numbered, (VALUES (2), (3)) s(k) WHERE n >= k AND i <= k)"""
SETS = f"""{TF}, {LOG}, held AS (SELECT l.qid, l.k, tf.doc_id, bool_or(l.i = 1) AS a, bool_or(l.i = 2) AS b, bool_or(l.i = 3) AS c FROM log l JOIN tf USING (term) GROUP BY ALL)"""


def query_log(t):
    """(qid, i, term, k): a query of k terms, 2 or 3, of each topic that has as many."""
    firsts = corpus.valid(corpus.tokens(topics(t).select(F.col("qid").alias("doc_id"), "text"))).groupBy("doc_id", "term").agg(F.min("pos").alias("at"))
    lists = firsts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("ts"))
    sized = lists.select("doc_id", "ts", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).filter(F.size("ts") >= F.col("k"))
    return sized.select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("qid"), "k", F.posexplode(F.slice("ts", 1, F.col("k"))).alias("i0", "x")).select("qid", (F.col("i0") + 1).alias("i"), "x.term", "k")


def conjunctions(t, k: int):
    log = query_log(t).filter(F.col("k") == k)
    return boolean.conjunction_of_blocks(log.select("qid", "term"), t.index().matching(log))


@query("q_bool_and2", f"WITH {SETS} SELECT qid, doc_id FROM held WHERE k = 2 AND a AND b")
def bool_and2(t):
    return conjunctions(t, 2)


@query("q_bool_and3", f"WITH {SETS} SELECT qid, doc_id FROM held WHERE k = 3 AND a AND b AND c")
def bool_and3(t):
    return conjunctions(t, 3)


@query("q_bool_or", f"WITH {SETS} SELECT qid, doc_id FROM held WHERE k = 2")
def bool_or(t):
    log = query_log(t).filter("k = 2")
    return boolean.union_of_blocks(log.select("qid", "term"), t.index().matching(log))


@query("q_bool_andnot", f"WITH {SETS} SELECT qid, doc_id FROM held WHERE k = 2 AND a AND NOT b")
def bool_andnot(t):
    log = query_log(t).filter("k = 2")
    return boolean.difference(log.select("qid", "i", "term"), t.index().matching(log))


NOT_TERM = "thanedble"


@query("q_bool_not", f"WITH {TF} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tf WHERE term = '{NOT_TERM}')")
def bool_not(t):
    return t("documents").select("doc_id").join(t.index().postings([NOT_TERM]), "doc_id", "left_anti")


EXPRESSIONS = {
    "e1": "license AND (worthless OR thanedble)", "e2": "thanedble & ~(onbleea | thintion)", "e3": "NOT (worthless OR license OR thanedble)",
    "e4": "nosuchterm OR einlich", "e5": "TRUE AND thshing", "e6": "FALSE OR", "e7": "(cionado + cionque) * !einlich",
}
_HAS = lambda w: f"list_contains(h, '{w}')"


@query(
    "q_bool_expr",
    f"""WITH {TF}, sets AS (SELECT d.doc_id, coalesce(s.h, []) AS h FROM documents d LEFT JOIN (SELECT doc_id, list(term) AS h FROM tf GROUP BY doc_id) s USING (doc_id))
SELECT 'e1' AS qid, doc_id FROM sets WHERE {_HAS('license')} AND ({_HAS('worthless')} OR {_HAS('thanedble')})
UNION ALL SELECT 'e2', doc_id FROM sets WHERE {_HAS('thanedble')} AND NOT ({_HAS('onbleea')} OR {_HAS('thintion')})
UNION ALL SELECT 'e3', doc_id FROM sets WHERE NOT ({_HAS('worthless')} OR {_HAS('license')} OR {_HAS('thanedble')})
UNION ALL SELECT 'e4', doc_id FROM sets WHERE {_HAS('einlich')}
UNION ALL SELECT 'e5', doc_id FROM sets WHERE {_HAS('thshing')}
UNION ALL SELECT 'e7', doc_id FROM sets WHERE ({_HAS('cionado')} OR {_HAS('cionque')}) AND NOT {_HAS('einlich')}""",
)
def bool_expr(t):
    """Seven expressions at once; the malformed one has no result."""
    return boolean.search(EXPRESSIONS, tf_of(t), t("documents"))


_PATTERNS = {
    2: {"a AND b": "a AND b", "a OR b": "a OR b", "a AND NOT b": "a AND NOT b"},
    3: {"a AND b AND c": "a AND b AND c", "(a OR b) AND NOT c": "(a OR b) AND NOT c", "(a AND b) OR c": "(a AND b) OR c"},
}


@query(
    "q_bool_patterns",
    f"WITH {SETS} " + " UNION ALL ".join(f"SELECT qid, '{n}' AS pattern, doc_id FROM held WHERE k = {k} AND ({c})" for k, g in _PATTERNS.items() for n, c in g.items()),
)
def bool_patterns(t):
    log = query_log(t)
    return boolean.patterns(log.select("qid", "i", "term"), t.index().matching(log))


def two_ways(t, k: int):
    """Sizes of the conjunctions by intersection of sorted lists and by counting documents, both block by block."""
    log = query_log(t).filter(F.col("k") == k)
    by_list = boolean.common_sizes(log.select("qid", "term"), t.index().matching(log)).withColumnRenamed("docs", "by_list")
    by_count = conjunctions(t, k).groupBy("qid").agg(F.count("*").alias("by_count"))
    return by_list.join(by_count, "qid", "left").select("qid", "by_list", F.coalesce("by_count", F.lit(0)).alias("by_count"))


@query("q_skip_and", f"WITH {SETS} SELECT qid, count(*) FILTER (WHERE a AND b) AS by_list, count(*) FILTER (WHERE a AND b) AS by_count FROM held WHERE k = 2 GROUP BY qid")
def skip_and(t):
    """By the skips of the longer list, of which only the segments are opened that may hold a document of the shorter, and by counting documents."""
    log = query_log(t).filter("k = 2")
    sized = log.join(t.index().vocabulary.select("term", "df"), "term", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("ts"))
    pairs = sized.filter("ts[1].df > 0").select("qid", F.col("ts")[0]["term"].alias("short"), F.col("ts")[1]["term"].alias("long"))
    segments = materialize(index.skip_segments(t.index().postings(log)), "segments")
    by_count = conjunctions(t, 2).groupBy("qid").agg(F.count("*").alias("by_count"))
    met = index.skip_and(pairs, segments).select("qid", F.col("docs").alias("by_list"))
    return met.join(by_count, "qid", "left").select("qid", "by_list", F.coalesce("by_count", F.lit(0)).alias("by_count"))


@query("q_taat_daat", f"WITH {SETS} SELECT qid, count(*) FILTER (WHERE a AND b AND c) AS by_list, count(*) FILTER (WHERE a AND b AND c) AS by_count FROM held WHERE k = 3 GROUP BY qid")
def taat_daat(t):
    return two_ways(t, 3)


@query("q_query_filter", f"WITH {TERMS}, {LOG} SELECT qid, count(*) AS n_terms FROM log LEFT JOIN terms USING (term) GROUP BY qid HAVING count(*) = count(terms.df)")
def query_filter(t):
    """Queries all of whose terms are in the vocabulary."""
    vocab = t.index().vocabulary.select("term", F.lit(1).alias("hit"))
    return query_log(t).join(vocab, "term", "left").groupBy("qid").agg(F.count("*").alias("n_terms"), F.count("hit").alias("h")).filter("h = n_terms").select("qid", "n_terms")


TOTALS = f"{TERMS}, {LOG}, totals AS (SELECT qid, k, CAST(sum(coalesce(terms.df, 0)) AS BIGINT) AS postings FROM log LEFT JOIN terms USING (term) GROUP BY qid, k)"


@query("q_query_posting_total", f"WITH {TOTALS} SELECT qid, postings FROM totals")
def query_posting_total(t):
    df = t.index().vocabulary.select("term", "df")
    return query_log(t).join(df, "term", "left").groupBy("qid").agg(F.sum(F.coalesce("df", F.lit(0))).alias("postings"))


@query(
    "q_posting_tertiles",
    f"""WITH {TOTALS}, o AS (SELECT qid, postings, row_number() OVER (ORDER BY postings, qid) - 1 AS i, count(*) OVER () AS n FROM totals),
cuts AS (SELECT max(postings) FILTER (WHERE i = n // 3) AS p33, max(postings) FILTER (WHERE i = 2 * n // 3) AS p66 FROM o)
SELECT qid, postings, CASE WHEN postings <= p33 THEN 'low' WHEN postings <= p66 THEN 'middle' ELSE 'high' END AS bucket FROM o, cuts""",
)
def posting_tertiles(t):
    """Buckets by the values at a third and two thirds of the sorted totals."""
    totals = materialize(query_posting_total(t), "totals")
    placed = ranks.numbered(totals, [F.col("postings")], ["qid"], "i")
    cuts = placed.crossJoin(totals.agg(F.count("*").alias("n"))).agg(
        F.max(F.when(F.col("i") - 1 == F.floor(F.col("n") / 3), F.col("postings"))).alias("p33"), F.max(F.when(F.col("i") - 1 == F.floor(2 * F.col("n") / 3), F.col("postings"))).alias("p66")
    )
    bucket = F.when(F.col("postings") <= F.col("p33"), "low").when(F.col("postings") <= F.col("p66"), "middle").otherwise("high")
    return totals.crossJoin(cuts).select("qid", "postings", bucket.alias("bucket"))


# Ranked retrieval

IDF = f"{TERMS}, {QTERMS}, idf AS (SELECT term, df, cf, ln((SELECT count(*) FROM documents) / df::DOUBLE) AS idf FROM terms)"
WEIGHTS = f"{IDF}, w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term) WHERE idf > 0), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"


@query("q_idf", f"WITH {IDF} SELECT term, df, round(idf, 10) AS idf FROM idf")
def idf(t):
    terms = t.index().vocabulary.select("term", "df")
    return rank.idf(tf_of(t), t("documents"), terms).withColumn("idf", F.round("idf", 10))


@query("q_doc_norms", f"WITH {WEIGHTS} SELECT doc_id, round(norm, 6) AS norm FROM norms")
def doc_norms(t):
    return rank.norms(rank.weights(tf_of(t), t("documents"))).withColumn("norm", F.round("norm", 6))


@query(
    "q_vsm_cosine",
    f"""WITH {WEIGHTS}, wq AS (SELECT qid, term, (1 + ln(qtf)) * idf AS wq FROM q JOIN idf USING (term) WHERE idf > 0),
nq AS (SELECT qid, sqrt(sum(wq * wq)) AS nq FROM wq GROUP BY qid),
s AS (SELECT qid, doc_id, sum(w * wq) / (any_value(norm) * any_value(nq)) AS score FROM wq JOIN w USING (term) JOIN norms USING (doc_id) JOIN nq USING (qid) GROUP BY qid, doc_id)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank, doc_id, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY rank < 10""",
)
def vsm_cosine(t):
    """The ten best documents of each topic by cosine."""
    return rank.cosine(tf_of(t), t("documents"), rank.query_terms(topics(t)), terms=t.index().vocabulary.select("term", "df"))


@query(
    "q_daat_cosine",
    f"""WITH {TERMS}, {LOG}, idf AS (SELECT term, log10((SELECT count(*) FROM documents) / df::DOUBLE) AS idf FROM terms),
dims AS (SELECT qid, i, term, idf FROM log JOIN idf USING (term)), nq AS (SELECT qid, sqrt(sum(idf * idf)) AS nq FROM dims GROUP BY qid HAVING sqrt(sum(idf * idf)) > 0),
s AS (SELECT qid, doc_id, sum((1 + log10(tf)) * idf * idf) AS dot, sqrt(sum(((1 + log10(tf)) * idf) ** 2)) AS nd FROM tf JOIN dims USING (term) GROUP BY qid, doc_id),
c AS (SELECT qid, doc_id, CASE WHEN nd > 0 THEN dot / (nd * nq) ELSE 0 END AS score FROM s JOIN nq USING (qid))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank, doc_id, round(score, 6) AS score FROM c QUALIFY rank < 10""",
)
def daat_cosine(t):
    q = query_log(t).select("qid", F.col("i").alias("pos"), "term")
    return rank.daat_cosine(t.index().postings(q), t("documents"), q)


_FORMULA = {
    "tfidf": "qtf * 1.2::DOUBLE * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avdl)) * log2(n / df::DOUBLE + 1)",
    "bm25": "tf * 9.0::DOUBLE * qtf / ((8.0::DOUBLE + qtf) * (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avdl) + tf)) * log2((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))",
    "jm": "log2(1 + 0.9::DOUBLE * tf * total / ((1 - 0.9::DOUBLE) * cf * dl))",
    "dirichlet": "log2(1 + tf * total / (2000.0::DOUBLE * cf)) + log2(2000.0::DOUBLE / (dl + 2000.0::DOUBLE))",
}
HITS = f"""{TERMS}, {QTERMS}, dls AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM tf GROUP BY doc_id),
coll AS (SELECT (SELECT sum(tf)::DOUBLE FROM tf) AS total, (SELECT count(*) FROM documents) AS n), coll2 AS (SELECT total, n, total / n AS avdl FROM coll),
hits AS (SELECT qid, doc_id, tf, qtf, df, cf, dl, total, n, avdl FROM q JOIN tf USING (term) JOIN terms USING (term) JOIN dls USING (doc_id), coll2)"""


def run_sql(models, k: int) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS model, qid, doc_id, sum({_FORMULA[m]}) AS score FROM hits GROUP BY qid, doc_id" for m in models)
    return f"""{HITS}, run AS (SELECT model, qid, row_number() OVER (PARTITION BY model, qid ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank, doc_id, round(score, 6) AS score FROM ({each}) QUALIFY rank < {k})"""


DEPTH = {"tfidf": 50, "bm25": 50, "jm": 1000, "dirichlet": 1000}


def retrieved(t, models, k: int):
    q, stored = rank.query_terms(topics(t)), t.index()
    return rank.retrieve(stored.postings(q), t("documents"), q, models, k, stored.vocabulary, stored.documents)


for _m in DEPTH:
    query(f"q_rank_{_m}", f"WITH {run_sql([_m], DEPTH[_m])} SELECT model, qid, rank, doc_id, score FROM run")(lambda t, m=_m: retrieved(t, (m,), DEPTH[m]))


@query("q_rank_union", f"WITH {run_sql(['tfidf', 'bm25'], 50)} SELECT model, qid, rank, doc_id, score FROM run")
def rank_union(t):
    return retrieved(t, ("tfidf", "bm25"), 50)


@query(
    "q_collection_stats",
    f"WITH {TERMS} SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_terms, CAST(sum(cf) AS BIGINT) AS n_tokens, CAST(sum(df) AS BIGINT) AS n_postings FROM terms",
)
def collection_stats(t):
    totals = t.index().vocabulary.agg(F.count("*").alias("n_terms"), F.sum("cf").alias("n_tokens"), F.sum("df").alias("n_postings"))
    return totals.crossJoin(t("documents").agg(F.count("*").alias("n_docs")))


# Evaluation: a document that contains a topic's text is relevant to it

QRELS = "qrels AS (SELECT b.item_id AS qid, d.doc_id, 1 AS label FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def qrels(t):
    return evaluate.containing(t("documents"), topics(t)).select("qid", "doc_id", F.lit(1).alias("label"))


@query("q_topics_with_qrels", f"WITH {QRELS} SELECT item_id AS qid FROM benchmark WHERE item_id IN (SELECT qid FROM qrels)")
def topics_with_qrels(t):
    return topics(t).join(qrels(t), "qid", "left_semi").select("qid")


MODELS = ("tfidf", "bm25", "jm", "dirichlet")
JUDGED = f"""{run_sql(MODELS, 1000)}, {QRELS}, total AS (SELECT qid, count(*) AS r FROM qrels GROUP BY qid),
judged AS (SELECT run.model, run.qid, run.rank, run.doc_id, coalesce(qrels.label, 0) AS rel, total.r,
  sum(coalesce(qrels.label, 0)) OVER (PARTITION BY run.model, run.qid ORDER BY run.rank) AS seen
  FROM run LEFT JOIN qrels ON run.qid = qrels.qid AND run.doc_id = qrels.doc_id LEFT JOIN total ON run.qid = total.qid)"""
MEASURED = f"""{JUDGED}, measured AS (SELECT model, qid,
  CASE WHEN max(r) IS NOT NULL THEN count(*) FILTER (WHERE rank < 10 AND rel = 1) / 10.0::DOUBLE END AS p10,
  sum(CASE WHEN rel = 1 THEN seen::DOUBLE / (rank + 1) ELSE 0 END) / max(r) AS ap,
  sum(CASE WHEN rank < 10 AND rel = 1 THEN 1 / log2(rank + 2.0::DOUBLE) ELSE 0 END) / any_value(CASE WHEN r IS NOT NULL THEN list_sum(list_transform(range(1, least(r, 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) END) AS ndcg10,
  count(*) FILTER (WHERE rank < r AND rel = 1)::DOUBLE / max(r) AS rprec FROM judged GROUP BY model, qid)"""


def run(t):
    return materialize(retrieved(t, MODELS, 1000), "run")


def measured(t):
    return materialize(evaluate.per_query(run(t), qrels(t)), "measured")


for _m in ("p10", "ap", "ndcg10", "rprec"):
    query(f"q_eval_{_m}", f"WITH {MEASURED} SELECT model, qid, round({_m}, 6) AS {_m} FROM measured")(lambda t, m=_m: measured(t).select("model", "qid", F.round(m, 6).alias(m)))

LEVELS = f"""{JUDGED}, levels AS (SELECT model, qid, l / 10.0::DOUBLE AS level, CASE WHEN max(r) IS NOT NULL THEN coalesce(max(seen::DOUBLE / (rank + 1)) FILTER (WHERE rel = 1 AND seen * 10 >= l * r), 0) END AS precision
  FROM judged, range(0, 11) x(l) GROUP BY model, qid, l)"""


@query("q_eval_rp11", f"WITH {LEVELS} SELECT model, qid, level, round(precision, 6) AS precision FROM levels")
def eval_rp11(t):
    return evaluate.interpolated(run(t), qrels(t)).withColumn("precision", F.round("precision", 6))


@query("q_eval_iprec_models", f"WITH {LEVELS} SELECT model, level, round(avg(precision), 6) AS precision FROM levels GROUP BY model, level")
def eval_iprec_models(t):
    return evaluate.interpolated(run(t), qrels(t)).groupBy("model", "level").agg(F.round(F.avg("precision"), 6).alias("precision"))


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.MEASURES)


@query("q_eval_global", f"WITH {MEASURED} SELECT model, {_MEANS} FROM measured GROUP BY model")
def eval_global(t):
    return evaluate.means(measured(t))


@query(
    "q_eval_experiment",
    f"""WITH {MEASURED}, every AS (SELECT m.model, {', '.join(f'coalesce(x.{m}, 0) AS {m}' for m in evaluate.MEASURES)} FROM (SELECT DISTINCT model FROM measured) m
CROSS JOIN (SELECT item_id AS qid FROM benchmark) b LEFT JOIN measured x ON x.model = m.model AND x.qid = b.qid) SELECT model, {_MEANS} FROM every GROUP BY model""",
)
def eval_experiment(t):
    return evaluate.experiment(measured(t), topics(t))


@query(
    "q_eval_describe",
    f"""WITH {MEASURED} SELECT model, count(ap) AS n, round(avg(ap), 6) AS mean, round(stddev_samp(ap), 6) AS std, round(min(ap), 6) AS min, round(quantile_cont(ap, 0.25), 6) AS q25,
round(quantile_cont(ap, 0.5), 6) AS q50, round(quantile_cont(ap, 0.75), 6) AS q75, round(max(ap), 6) AS max FROM measured GROUP BY model""",
)
def eval_describe(t):
    return evaluate.describe(measured(t))


@query(
    "q_eval_hist",
    f"""WITH {MEASURED}, ends AS (SELECT model, min(ap) AS lo, max(ap) AS hi FROM measured GROUP BY model)
SELECT model, CAST(CASE WHEN hi > lo THEN least(floor((ap - lo) * 10 / (hi - lo) + 1e-9::DOUBLE), 9) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM measured JOIN ends USING (model) WHERE ap IS NOT NULL GROUP BY ALL""",
)
def eval_hist(t):
    return evaluate.histogram(measured(t))


PAIRED = f"{MEASURED}, v AS (SELECT model, qid, round(ap, 9) AS ap FROM measured WHERE ap IS NOT NULL)"


@query(
    "q_model_compare",
    f"""WITH {PAIRED} SELECT count(*) FILTER (WHERE b.ap > a.ap) AS wins, count(*) FILTER (WHERE b.ap < a.ap) AS losses, count(*) FILTER (WHERE b.ap = a.ap) AS ties
FROM v a JOIN v b USING (qid) WHERE a.model = 'tfidf' AND b.model = 'dirichlet'""",
)
def model_compare(t):
    return evaluate.compare(measured(t), "tfidf", "dirichlet")


@query(
    "q_eval_baseline",
    f"""WITH {PAIRED} SELECT b.model, count(*) FILTER (WHERE b.ap - a.ap > 0) AS better, count(*) FILTER (WHERE b.ap - a.ap < 0) AS worse,
CASE WHEN stddev_samp(b.ap - a.ap) > 0 THEN round(avg(b.ap - a.ap) / (stddev_samp(b.ap - a.ap) / sqrt(count(*))), 4) END AS t
FROM v a JOIN v b USING (qid) WHERE a.model = 'tfidf' AND b.model <> 'tfidf' GROUP BY b.model""",
)
def eval_baseline(t):
    return evaluate.baseline(measured(t), "tfidf")


@query(
    "q_vectors_cosine",
    """WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
c AS (SELECT label, list(s ORDER BY i) AS centre FROM (SELECT label, i, sum(embedding[i]::DOUBLE) AS s FROM n, range(1, 65) r(i) WHERE i <= len(embedding) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label AS label, list_sum(list_transform(list_zip(embedding, centre), lambda p: p[1]::DOUBLE * p[2])) / (norm * sqrt(list_sum(list_transform(centre, lambda x: x * x)))) AS score FROM n, c)
SELECT vec_id, label, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 8) DESC, label) = 1""",
)
def vectors_cosine(t):
    """The label whose sum of vectors is nearest to each dense vector by cosine."""
    vectors = t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    sums = vectors.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    centres = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e, c = F.col("e"), F.col("c")
    scored = vectors.drop("label").crossJoin(centres).select("vec_id", "label", (dot(e, c) / (F.sqrt(dot(e, e)) * F.sqrt(dot(c, c)))).alias("score"))
    best = scored.groupBy("vec_id").agg(F.max(F.struct(F.round("score", 8).alias("r"), (-F.col("label")).alias("l"), "score")).alias("m"))
    return best.select("vec_id", (-F.col("m.l")).alias("label"), F.round("m.score", 4).alias("score"))


# Other analyzers


@query("q_vsm_cosine_typed")
def vsm_cosine_typed(t):
    """The ten best documents of each topic by cosine over typed tokens."""
    tf = materialize(index.term_frequencies(t("documents"), corpus.typed_terms), "typed")
    return rank.cosine(tf, t("documents"), rank.query_terms(topics(t), corpus.typed_terms))


@query("q_rank_bm25_stemmed")
def rank_bm25_stemmed(t):
    """BM25 over Porter stems of valid words."""
    analyzer = corpus.stemmed_terms(stem.porter)
    tf = materialize(index.term_frequencies(t("documents"), analyzer), "stemmed")
    return rank.retrieve(tf, t("documents"), rank.query_terms(topics(t), analyzer), ("bm25",), DEPTH["bm25"])


@query("q_eval_significance")
def eval_significance(t):
    """The paired t-test of each model against the first."""
    return evaluate.significance(measured(t), "tfidf").select("model", "n", F.round("t", 4).alias("t"), F.round("p", 6).alias("p"))


@query(
    "q_eval_common",
    f"""WITH {MEASURED}, v AS (SELECT model, qid, round(ap, 6) AS ap FROM measured WHERE ap IS NOT NULL)
SELECT a.qid, a.ap AS tfidf, b.ap AS jm, c.ap AS dirichlet FROM v a JOIN v b USING (qid) JOIN v c USING (qid) WHERE a.model = 'tfidf' AND b.model = 'jm' AND c.model = 'dirichlet'""",
)
def eval_common(t):
    """Average precision of three models on the queries that all have."""
    models = ("tfidf", "jm", "dirichlet")
    return evaluate.common_queries(measured(t), models).select("qid", *[F.round(m, 6).alias(m) for m in models])
