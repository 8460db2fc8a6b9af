"""Ranks and running totals over whole tables, without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, bucket: list, order: list, name: str) -> DataFrame:
    """Row numbers from 1 in the order of bucket, then order.

    Only the buckets' counts go through one task; rows are numbered within their bucket. bucket must be a
    non-decreasing function of the order, with few distinct values; (column, 'desc') sorts downwards.
    """
    keys = [f"__b{i}" for i in range(len(bucket))]
    df = df.select("*", *[_bare(c).alias(k) for c, k in zip(bucket, keys)])
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).select(*[F.col(k).alias("r" + k) for k in keys], "__n")
    before = Window.orderBy(*[_direction(c, F.col("r" + k)) for c, k in zip(bucket, keys)]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col("r" + k)) for k in keys]
    ranked = df.join(counts, on).withColumn(name, F.col("__before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.drop(*keys, *["r" + k for k in keys], "__n", "__before")


def _bare(c):
    return c[0] if isinstance(c, tuple) else c


def _direction(c, col: Column) -> Column:
    return col.desc() if isinstance(c, tuple) and c[1] == "desc" else col.asc()


def in_order(df: DataFrame, order: list, name: str, parts: int = 200) -> DataFrame:
    """Row numbers from 1 in any order that has no ties, by ranges of it that Spark samples; df is stored once.

    Only the ranges' counts go through one task; equal values of a leading column are cut by the next ones.
    """
    from termloom.session import materialize

    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__q", F.coalesce(before, F.lit(0)).alias("__before"))  # parts rows
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(counts), F.col("__p") == F.col("__q")).withColumn(name, F.col("__before") + within).drop("__p", "__q", "__before")


def by_frequency(terms: DataFrame, count: str = "cf", name: str = "rank") -> DataFrame:
    """Ranks by falling count, equal counts by term."""
    return numbered(terms, [(F.col(count), "desc"), F.substring("term", 1, 2)], ["term"], name)


def term_ids(terms: DataFrame, name: str = "term_id") -> DataFrame:
    """Numbers from 1 in alphabetical order; terms must be distinct."""
    return numbered(terms, [F.substring("term", 1, 3)], ["term"], name)


def running(df: DataFrame, value: str, key: str, order: list, name: str, width: int = 4096) -> DataFrame:
    """Running sum of value in the order of an integer key, then order: name, without the row's own value before it.

    Sums of ranges of width keys go through one task, those of keys through one task a range, rows through one a key.
    """
    df = df.withColumn("__r", F.floor(F.col(key) / width))
    per_key = df.groupBy("__r", key).agg(F.sum(value).alias("__s"))
    per_range = per_key.groupBy("__r").agg(F.sum("__s").alias("__t"))
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select("__r", F.coalesce(F.sum("__t").over(prior(Window.orderBy("__r"))), F.lit(0)).alias("__a"))
    per_key = per_key.select("__r", key, F.coalesce(F.sum("__s").over(prior(Window.partitionBy("__r").orderBy(key))), F.lit(0)).alias("__b"))
    offsets = per_key.join(per_range, "__r").select(key, (F.col("__a") + F.col("__b")).alias("__o"))
    within = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, key).withColumn(name, F.col("__o") + F.sum(value).over(within)).drop("__r", "__o")
