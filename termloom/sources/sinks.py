"""Writers in the forms in which the retrieval programs leave their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import urls
from termloom.operators import index, ranks


def write_term_list(terms: DataFrame, path: str) -> None:
    """Lines 'term cf df' in alphabetical order."""
    terms.orderBy("term").select(F.concat_ws(" ", "term", F.col("cf").cast("string"), F.col("df").cast("string")).alias("value")).write.text(path)


def write_run(run: DataFrame, path: str) -> None:
    """A CSV folder for each query."""
    run.repartition("qid").sortWithinPartitions("qid", "rank").write.partitionBy("qid").csv(path, header=True)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges src, dst as CSV; duplicates stay."""
    edges.select("src", "dst").write.csv(path, header=True)


def write_pages(ranked: DataFrame, path: str) -> None:
    """Pages by falling PageRank, as CSV."""
    ranked.orderBy(F.desc("pagerank"), "url").write.csv(path, header=True)


def write_statistics(stats: DataFrame, path: str) -> None:
    """The row of corpus_statistics as six lines of text, means with two decimals."""
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    lines = [
        F.col("n_docs"), F.concat_ws(" ", "n_tokens", "n_terms"), F.concat_ws(" ", two("avg_tokens"), two("avg_terms")), two("avg_length"),
        F.concat_ws(" ", "min_tokens", "min_terms", "max_tokens", "max_terms"), F.col("hapax"),
    ]
    stats.select(F.explode(F.array(*[x.cast("string") for x in lines])).alias("value")).coalesce(1).write.text(path)


def write_extremes(terms: DataFrame, path: str, k: int = 10) -> None:
    """Two blocks of lines 'term cf', the k most and the k least frequent terms, each under a heading."""
    line = F.concat_ws(" ", "term", F.col("cf").cast("string")).alias("value")
    blocks = []
    for title, order in (("most frequent", F.desc("cf")), ("least frequent", F.asc("cf"))):
        top = terms.orderBy(order, "term").limit(k).agg(F.collect_list(F.struct("cf", "term")).alias("l"))
        top = top.select(F.posexplode("l").alias("i", "x")).select("i", F.col("x.term").alias("term"), F.col("x.cf").alias("cf")).select(F.lit(len(blocks)).alias("b"), "i", line)
        blocks.append(terms.sparkSession.createDataFrame([(len(blocks), -1, title)], "b int, i int, value string").union(top))
    blocks[0].union(blocks[1]).orderBy("b", "i").coalesce(1).select("value").write.text(path)


def write_stem_comparison(words: DataFrame, path: str) -> None:
    """words(term, porter, lancaster) in alphabetical order, as CSV."""
    words.select("term", "porter", "lancaster").orderBy("term").write.csv(path, header=True)


def write_heaps(curve: DataFrame, path: str) -> None:
    """Pairs n, V of a vocabulary's growth in the order of n, as CSV."""
    curve.select("n", F.col("v").alias("V")).orderBy("n").write.csv(path, header=True)


def write_run_table(run: DataFrame, topics: DataFrame, docs: DataFrame, path: str) -> None:
    """model, qid, query, rank, docno, score, title, filename of run, topics(qid, text) and docs(doc_id, title, name), as CSV."""
    full = run.join(topics.select("qid", F.col("text").alias("query")), "qid", "left").join(docs.select("doc_id", "title", F.col("name").alias("filename")), "doc_id", "left")
    full.select("model", "qid", "query", "rank", F.col("doc_id").alias("docno"), "score", "title", "filename").orderBy("model", "qid", "rank").write.csv(path, header=True)


def write_rankings(run: DataFrame, docs: DataFrame, path: str) -> None:
    """For each query a CSV folder of Pos (from 1), Documento (the document's name) and Coseno with six decimals."""
    named = run.join(docs.select("doc_id", "name"), "doc_id", "left")
    rows = named.select("qid", (F.col("rank") + 1).alias("Pos"), F.col("name").alias("Documento"), F.format_string("%.6f", F.col("score")).alias("Coseno"))
    rows.repartition("qid").sortWithinPartitions("qid", "Pos").write.partitionBy("qid").csv(path, header=True)


def write_ranked_pages(ranked: DataFrame, visited: DataFrame, path: str) -> None:
    """url, orden_bfs, prof_fisica, pagerank and authority (eight decimals) by falling PageRank, of ranked pages and a crawl's visited(url, ord, logical)."""
    placed = ranks.in_order(visited.select("url", "logical", "ord"), ["logical", "ord", "url"], "orden_bfs").select("url", "orden_bfs")
    eight = lambda c: F.format_string("%.8f", F.col(c)).alias(c)
    rows = ranked.join(placed, "url", "left").orderBy(F.desc("pagerank"), "url")
    rows.select("url", "orden_bfs", urls.physical_depth(F.col("url")).alias("prof_fisica"), eight("pagerank"), eight("authority")).write.csv(path, header=True)


def write_skips(tf: DataFrame, path: str) -> None:
    """Skip lists sorted by term, and a vocabulary with the number of skips and the offset of a term's first, at eight bytes each."""
    skips = index.skip_list(tf)
    skips.repartitionByRange("term", "idx").sortWithinPartitions("term", "idx").write.parquet(f"{path}/skips")
    stored = tf.sparkSession.read.parquet(f"{path}/skips").groupBy("term").agg(F.count("*").alias("df"))
    index.vocab_offsets(ranks.term_ids(stored), 8).withColumnRenamed("df", "n_skips").write.parquet(f"{path}/vocabulary")
