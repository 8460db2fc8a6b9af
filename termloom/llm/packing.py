"""Best-fit decreasing packing of documents into fixed-size training sequences."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CapacityTree:
    """Open bins by remaining capacity, under a segment tree that counts them.

    tightest(need) finds the least remaining capacity of at least need in O(log capacity) steps; among equals
    the bin opened first is taken.
    """

    def __init__(self, capacity: int):
        self.base = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: dict[int, list[int]] = {}

    def _bump(self, remaining: int, by: int) -> None:
        i = remaining + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, remaining: int, bin_no: int) -> None:
        heapq.heappush(self.bins.setdefault(remaining, []), bin_no)
        self._bump(remaining, 1)

    def tightest(self, need: int) -> int | None:
        count, i = self.count, need + self.base
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i *= 2
                if not count[i]:
                    i += 1
        return i - self.base

    def take(self, remaining: int) -> int:
        self._bump(remaining, -1)
        return heapq.heappop(self.bins[remaining])


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, which come in the order of packing; each is 1 to capacity."""
    tree, out, opened = CapacityTree(capacity), [], 0
    for n in lengths:
        room = tree.tightest(n)
        if room is None:
            room, no = capacity, opened
            opened += 1
        else:
            no = tree.take(room)
        if room > n:
            tree.add(room - n, no)
        out.append(no)
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_docs: int = 50_000) -> DataFrame:
    """Pack documents into bins of capacity words by best fit, longest first.

    Length is the number of words (runs of characters that aren't white space). A longer document is cut into
    pieces of capacity words, each a full bin, and a rest that is packed like a document. Documents go to
    shards by hash, one for every shard_docs rows (a table of fewer is one shard); each shard is packed by itself, so that the work spreads over the cluster.
    In a shard at most one bin is half full or less: what would fit into another bin is never put in a new one.

    Returns doc_id, piece, start (first word, from 0), length, bin_id. Null, empty and blank texts have no words and aren't
    packed. Equal lengths go by doc_id, then piece. Repeated rows are packed each. An empty table gives no rows.
    Null doc_id: packed last among equals, doc_id stays null; the hash takes in the length, so null ids spread over shards. Other columns are ignored.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    sized = docs.select("doc_id", F.regexp_count(F.col("text"), F.lit(r"\S+")).cast("bigint").alias("n")).filter(F.col("n") > 0)
    full = (F.col("n") / capacity).cast("bigint")
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    pieces = pieces.select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"),
        F.when(F.col("piece") < full, F.lit(capacity)).otherwise(F.col("n") % capacity).cast("bigint").alias("length"),
        F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)).alias("shard"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        pdf["bin_id"] = (int(pdf["shard"].iloc[0]) << 32) + pd.Series(best_fit(pdf["length"].tolist(), capacity), index=pdf.index, dtype="int64")
        return pdf[["doc_id", "piece", "start", "length", "bin_id"]].astype({"doc_id": "Int64"})

    return pieces.groupBy("shard").applyInPandas(pack, "doc_id long, piece long, start long, length long, bin_id long")


def op8_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
