"""Connected components of pairs, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize, release


def components(pairs: DataFrame) -> DataFrame:
    """(id, label) for each id in pairs(a, b): label is the least id of its component.

    Every id first points at its least neighbour, and pairs shrink to those between different targets, so
    that a group of n copies leaves n rows rather than n^2. Rounds follow until no label changes; each
    takes the least label around and then the label of that label, and is written to the shared folder.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m")), "nearest")
    ma, mb = near.select(F.col("x").alias("a"), F.col("m").alias("p")), near.select(F.col("x").alias("b"), F.col("m").alias("q"))
    links = pairs.select("a", "b").join(ma, "a").join(mb, "b").filter("p <> q").select("p", "q").distinct()
    edges = links.union(near.select(F.col("x").alias("p"), F.col("m").alias("q")).filter("p <> q"))
    edges = materialize(edges.select(F.col("p").alias("x"), F.col("q").alias("y")).union(edges.select(F.col("q").alias("x"), F.col("p").alias("y"))).distinct(), "edges")
    labels = near.select(F.col("x").alias("id"), F.col("m").alias("label"))
    before = None
    while True:
        around = edges.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("l"))
        step = labels.join(around, "id", "left").select("id", F.col("label").alias("old"), F.least(F.col("label"), F.coalesce("l", "label")).alias("l"))
        target = labels.select(F.col("id").alias("l"), F.col("label").alias("ll"))
        new = materialize(step.join(target, "l", "left").select("id", F.least("l", F.coalesce("ll", "l")).alias("label"), "old"), "labels")
        changed = new.filter("label <> old").limit(1).count()
        release(before)  # new has what is needed of it
        before, labels = new, new.select("id", "label")
        if not changed:
            return labels
