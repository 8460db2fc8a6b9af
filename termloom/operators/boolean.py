"""Boolean retrieval: a parser, and evaluation of all queries in one pass over the postings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """op is term, and, or, not, true or false."""

    op: str
    args: tuple = ()


_SIGN = {"&": "and", "*": "and", "|": "or", "+": "or", "~": "not", "!": "not"}
_LEX = re.compile(r"\s*(?:([()&|~!*+])|([^\W]+))")


def parse(query: str) -> Node:
    """NOT binds closest, then AND, then OR; words in any case; ValueError if the query is malformed."""
    tokens, at, text = [], 0, query.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"unexpected sign at {at} in {query!r}")
        word = m[1] or m[2]
        low = word.lower()
        tokens.append(_SIGN.get(word) or (low if low in ("and", "or", "not", "true", "false", "(", ")") else ("term", low)))
        at = m.end()
    tokens.append("end")

    def level(op: str, inner):
        node = inner()
        args = [node]
        while tokens[0] == op:
            tokens.pop(0)
            args.append(inner())
        return node if len(args) == 1 else Node(op, tuple(args))

    def atom() -> Node:
        t = tokens.pop(0)
        if t == "not":
            return Node("not", (atom(),))
        if t == "(":
            node = either()
            if tokens.pop(0) != ")":
                raise ValueError(f"missing ) in {query!r}")
            return node
        if t in ("true", "false"):
            return Node(t)
        if isinstance(t, tuple):
            return Node(t[0], (t[1],))
        raise ValueError(f"unexpected {t} in {query!r}")

    def either() -> Node:
        return level("or", lambda: level("and", atom))

    node = either()
    if tokens != ["end"]:
        raise ValueError(f"unexpected {tokens[0]} in {query!r}")
    return node


def _terms(node: Node) -> set[str]:
    return set() if node.op in ("true", "false") else {node.args[0]} if node.op == "term" else {t for a in node.args for t in _terms(a)}


def condition(node: Node, has: Column) -> Column:
    """The query as a condition on the set of a document's terms."""
    if node.op == "term":
        return F.array_contains(has, node.args[0])
    if node.op in ("true", "false"):
        return F.lit(node.op == "true")
    parts = [condition(a, has) for a in node.args]
    if node.op == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.op == "and" else out | p
    return out


def search(queries: dict[str, str], tf: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id) for named queries; unknown terms match nothing, and a malformed query has no result.

    One pass: postings of the queries' terms are grouped by document into a set, documents without any are joined so that NOT sees them.
    """
    trees = {}
    for qid, q in queries.items():
        try:
            trees[qid] = parse(q)
        except ValueError:
            continue
    terms = sorted({t for n in trees.values() for t in _terms(n)})
    held = tf.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.collect_set("term").alias("__h"))
    rows = docs.select("doc_id").join(held, "doc_id", "left").withColumn("__h", F.coalesce("__h", F.array().cast("array<string>")))
    hits = F.filter(F.array(*[F.when(condition(n, F.col("__h")), F.lit(q)) for q, n in trees.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(hits).alias("qid"), "doc_id")


def conjunction(query_terms: DataFrame, tf: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents that have all terms of a query (qid, term): one join, one count."""
    need = query_terms.groupBy("qid").agg(F.count("*").alias("need"))
    return query_terms.join(tf.select("term", "doc_id"), "term").groupBy("qid", "doc_id").agg(F.count("*").alias("n")).join(need, "qid").filter("n = need").select("qid", "doc_id")


def lists(query_terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_terms(qid, term, ..) with the docs of blocks(term, blk, docs) that hold the term: a row a block, not a posting. Queries are broadcast."""
    return blocks.select("term", "blk", "docs").join(F.broadcast(query_terms), "term")


def rows_of(query_terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, blk, doc_id, ..): a row a posting of a query's term. All of a query's rows of a block are in one task, so that grouping by them sends nothing more."""
    return lists(query_terms, blocks).repartition("qid", "blk").select(*query_terms.columns, "blk", F.explode("docs").alias("doc_id"))


def _common(lists: Column) -> Column:
    return F.aggregate(F.slice(lists, 2, F.size(lists)), lists[0], lambda a, x: F.array_intersect(a, x))


def common_sizes(query_terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, docs): in how many documents all terms of a query meet, by intersection of sorted lists block by block; of queries that have a posting at all."""
    need = query_terms.groupBy("qid").agg(F.count("*").alias("need"))
    met = lists(query_terms.join(need, "qid"), blocks).groupBy("qid", "need", "blk").agg(F.collect_list("docs").alias("ls"))
    size = F.when(F.size("ls") == F.col("need"), F.size(_common(F.col("ls")))).otherwise(0)
    return met.groupBy("qid").agg(F.sum(size).cast("bigint").alias("docs"))


def conjunction_of_blocks(query_terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents that have all terms of a query (qid, term), counted block by block."""
    need = query_terms.groupBy("qid").agg(F.count("*").alias("need"))
    return rows_of(query_terms.join(need, "qid"), blocks).groupBy("qid", "blk", "doc_id", "need").agg(F.count("*").alias("n")).filter("n = need").select("qid", "doc_id")


def difference(query_terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents with the first term of a query (qid, i, term) and not with the second."""
    side = lambda i: F.flatten(F.collect_list(F.when(F.col("i") == i, F.col("docs"))))
    met = lists(query_terms, blocks).groupBy("qid", "blk").agg(side(1).alias("a"), side(2).alias("b"))
    return met.select("qid", F.explode_outer(F.array_except("a", "b")).alias("doc_id")).filter("doc_id is not null")


def union_of_blocks(query_terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents with a term of a query (qid, term)."""
    met = lists(query_terms, blocks).groupBy("qid", "blk").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
    return met.select("qid", F.explode("docs").alias("doc_id"))


def patterns(query_terms: DataFrame, tf: DataFrame) -> DataFrame:
    """(qid, pattern, doc_id): three templates each for queries of two and of three terms (qid, i, term), over a table of queries. tf: postings, or blocks of them."""
    size = query_terms.groupBy("qid").agg(F.count("*").alias("size"))
    rows, at = (rows_of(query_terms, tf), ["qid", "blk", "doc_id"]) if "docs" in tf.columns else (query_terms.join(tf.select("term", "doc_id"), "term"), ["qid", "doc_id"])
    held = rows.groupBy(*at).agg(
        *[(F.max(F.when(F.col("i") == i, 1).otherwise(0)) == 1).alias(f"t{i}") for i in (1, 2, 3)]
    )
    a, b, c = F.col("t1"), F.col("t2"), F.col("t3")
    two = {"a AND b": a & b, "a OR b": a | b, "a AND NOT b": a & ~b}
    three = {"a AND b AND c": a & b & c, "(a OR b) AND NOT c": (a | b) & ~c, "(a AND b) OR c": (a & b) | c}
    hit = [F.when((F.col("size") == n) & cond, F.lit(name)) for n, group in ((2, two), (3, three)) for name, cond in group.items()]
    return held.join(size, "qid").select("qid", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("pattern"), "doc_id")
