"""Incremental indexing of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators import index


def append_postings(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the postings of each micro-batch of streaming docs(doc_id, text) below path, one folder a batch.

    A batch that is repeated after a failure overwrites its own folder, so that nothing counts twice.
    """

    def save(batch: DataFrame, number: int) -> None:
        index.term_frequencies(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_term_counts(docs: DataFrame, ts: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, term, cf) of a stream with event times ts; what is later than the watermark is dropped."""
    from termloom.functions import text as tx

    terms = docs.withWatermark(ts, late).select(ts, F.explode(tx.tokens_words(F.col("text"))).alias("term"))
    return terms.groupBy(F.window(ts, window), "term").agg(F.count("*").alias("cf"))
