"""Vector bin packing of document groups into shards that balance bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import ranks
from termloom.session import materialize

DIMS = ("bytes", "tokens", "rows")


def place(groups: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each group (a row of sizes), largest first, where the dot product with what is left is highest.

    Sizes are shares of a shard's capacity, which is 1 in every dimension. A group fits if no dimension
    goes below 0; if it fits nowhere, all shards are candidates, by the same product. Ties: the lowest shard.
    """
    left = np.ones((n_shards, groups.shape[1]))
    out = np.empty(len(groups), dtype=np.int64)
    for i in np.argsort(-groups.max(axis=1), kind="stable"):
        score = left @ groups[i]
        fits = (left >= groups[i] - 1e-12).all(axis=1)
        out[i] = np.argmax(np.where(fits, score, -np.inf) if fits.any() else score)
        left[out[i]] -= groups[i]
    return out


def dealt(pieces: DataFrame, unit: list[float], cells: int) -> DataFrame:
    """pieces with a cell: all of one shape (which dimension is largest, and by how much) in a row, from large to small, dealt back and forth.

    Sizes of about the same logarithm are in the order of a hash, so that a table of equal pieces is numbered by many tasks.
    """
    share = [F.col(d) / F.lit(u) for d, u in zip(DIMS, unit)]
    top, low = F.greatest(*share), F.least(*share)
    log = lambda x, k: F.floor(k * F.log2(F.greatest(x, F.lit(1e-12)))).cast("int")
    shape = F.concat(*[F.when(x == top, str(k)).otherwise("") for k, x in enumerate(share)])
    bucket = [shape, F.greatest(log(low, 1) - log(top, 1), F.lit(-6)), -log(top, 8), F.pmod(F.xxhash64("g", "part", F.lit(3)), F.lit(256))]
    placed = ranks.numbered(pieces, bucket, [top.desc(), "g", "part"], "__at")
    at = F.pmod(F.col("__at") - 1, F.lit(2 * cells))
    return placed.withColumn("cell", F.when(at < cells, at).otherwise(2 * cells - 1 - at)).drop("__at")


def shard_documents(
    docs: DataFrame, shard_bytes: int = 16 << 20, parts_per_shard: int = 16, cell_shards: int = 64, slack: float = 0.02, group_col: str = "source"
) -> DataFrame:
    """Assign documents to shards of about shard_bytes, balancing bytes, tokens and rows jointly.

    Documents of one value of group_col stay together as far as that is balanced: a group larger than
    1/parts_per_shard of a shard, in any dimension, is split by hash of doc_id into equal parts. The pieces are dealt to cells of
    cell_shards shards in turn, back and forth, pieces of one shape together and the largest first; so the loads of
    cells differ by few pieces in each dimension. Each cell is packed in a task of its own, and nothing is collected, whatever the number of shards.
    Capacity is the cell's mean load plus slack.

    Returns doc_id, shard_id, bytes, tokens (runs that aren't white space). Null texts have 0 bytes and
    tokens, and are sharded; a null group is a group; a null doc_id is hashed as null. A document larger than a shard overfills one. Repeated rows
    go together. Equal groups are placed in the order of their keys. An empty table gives no rows. Other columns are ignored.
    """
    sized = docs.select(
        "doc_id", F.col(group_col).cast("string").alias("g"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("tokens"),
    )
    sized = materialize(sized, "sizes")  # texts are read once
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    by_group = sized.groupBy("g").agg(*sums)
    total = by_group.agg(*[F.sum(d).alias(d) for d in DIMS]).first()
    n_shards = max(1, round((total["bytes"] or 0) / shard_bytes))
    share = F.greatest(*[F.col(d) / F.lit(max(1, total[d] or 0) / n_shards) for d in DIMS])
    parts = by_group.select(F.col("g").alias("pg"), F.greatest(F.lit(1), F.ceil(share * parts_per_shard)).cast("bigint").alias("parts"))
    cut = sized.join(parts, F.col("g").eqNullSafe(F.col("pg"))).select(
        "doc_id", "g", "bytes", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).alias("part")
    )
    cells = max(1, -(-n_shards // cell_shards))
    pieces = dealt(cut.groupBy("g", "part").agg(*sums), [max(1, total[d] or 0) / n_shards for d in DIMS], cells)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        first, last = cell * n_shards // cells, (cell + 1) * n_shards // cells
        pdf = pdf.sort_values(["g", "part"]).reset_index(drop=True)
        sizes = pdf[list(DIMS)].to_numpy(dtype=float)
        capacity = np.maximum(sizes.sum(axis=0), 1) / (last - first) * (1 + slack)
        pdf["shard_id"] = first + place(sizes / capacity, last - first)
        return pdf[["g", "part", "shard_id"]]

    placed = pieces.groupBy("cell").applyInPandas(pack, "g string, part long, shard_id long").select(F.col("g").alias("pg"), F.col("part").alias("pp"), "shard_id")
    return cut.join(placed, F.col("g").eqNullSafe(F.col("pg")) & (F.col("part") == F.col("pp"))).select("doc_id", "shard_id", "bytes", "tokens")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
