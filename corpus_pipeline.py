"""The training-data pipeline: filters and dedups documents, then packs them into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import jaccard, line_spread, packing, substrings, toxicity
from termloom.session import materialize, release


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the toxic ones, by a lexicon induced from these documents and the labels table.

    Null, empty and blank texts aren't toxic and stay, and so do all documents if nothing is labelled. Whole texts are scored, however long; repeated rows alike.
    A null doc_id is scored like any. Equal scores are treated alike. Further columns stay. An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of ten or more sites, which stay in the first document alone; n_chars is counted again.

    Null, empty and blank texts go, as documents that lose all their text do. A null site isn't counted; a null doc_id is one document, never
    the first if a line has another. Repeated rows are treated alike. Further columns stay. An empty table stays empty.
    """
    return _recounted(line_spread.site_spread_dedup(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id.

    Null ids and texts without words stay. Rows that repeat a doc_id stay or go together. Further columns stay. An empty table stays empty.
    """
    return jaccard.keep_one(docs)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 or more words that an earlier one has, by the order of a hash of doc_id; n_chars is counted again.

    A document of which nothing is left goes; null, empty and blank texts stay as they are. Rows that repeat a doc_id, null ones too, are one document,
    whose own repeats stay. Further columns stay. An empty table stays empty.
    """
    return _recounted(substrings.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2048 words: doc_id, piece, start, length, bin_id.

    Null, empty and blank texts have no pieces, long ones several. Equal lengths go by doc_id, then piece; null ids are packed last among equals.
    Repeated rows are packed each. Further columns are left. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("substring dedup", dedup_substrings),
    ("best-fit packing", pack),
]

#: SQL can express neither the lexicon's walks nor best-fit packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
