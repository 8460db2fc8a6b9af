"""Line dedup by spread over sites: HyperLogLog sketches, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.lines import keep_lines, line_hashes

#: Five standard errors of a sketch with 2^12 registers.
BAND = 5 * 1.04 / 64


def site_spread_dedup(docs: DataFrame, min_sites: int = 10, site_col: str = "source") -> DataFrame:
    """Drop lines that stand on at least min_sites distinct sites, except in the first document that has them.

    Each line hash gets a HyperLogLog sketch of its sites, merged by aggregation. Lines whose estimate is
    within five standard errors (and one site at least) of the threshold get an exact distinct count.
    The document with the least doc_id keeps such a line. Lines are compared in normal form; blank ones stay.

    Returns the columns of docs. A document that loses all that isn't white space is dropped; so are null
    and empty texts, and those of white space. A null site isn't counted. Null doc_id: one document, never the first
    if a line has another. Repeated rows: each is treated alike. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))  # no name of docs can clash
    row = F.col("__row")
    lines = rows.select(row["doc_id"].alias("__d"), row[site_col].cast("string").alias("__s"), F.explode(line_hashes(row["text"])).alias("__l"))
    spread = lines.groupBy("__l").agg(F.hll_sketch_estimate(F.hll_sketch_agg("__s", 12)).alias("__e"), F.min("__d").alias("__first"))
    margin = max(1.0, BAND * min_sites)
    maybe = spread.filter(F.col("__e") >= min_sites - margin)
    sure = maybe.filter(F.col("__e") > min_sites + margin).select("__l", "__first")
    near = maybe.filter(F.col("__e") <= min_sites + margin).select("__l", "__first")
    exact = (
        lines.join(near, "__l").groupBy("__l").agg(F.count_distinct("__s").alias("__n"), F.min("__first").alias("__first"))
        .filter(F.col("__n") >= min_sites).select("__l", "__first")
    )
    boiler = sure.unionByName(exact)
    dropped = (
        lines.join(boiler, "__l").filter(~F.col("__d").eqNullSafe(F.col("__first")))
        .groupBy(F.col("__d").alias("__dd")).agg(F.collect_set("__l").alias("__dropped"))
    )
    out = rows.join(dropped, row["doc_id"].eqNullSafe(F.col("__dd")), "left").withColumn("__text", keep_lines(row["text"], F.col("__dropped")))
    return out.filter(F.col("__text").rlike(r"\S")).select(*[F.col("__text").alias("text") if c == "text" else row[c].alias(c) for c in docs.columns])


def op6_line_spread(spark, sf_dir: str) -> DataFrame:
    return site_spread_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_OP6 = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
normal AS (SELECT doc_id, source, pos, line, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS nl FROM lines),
boiler AS (SELECT nl, min(doc_id) AS first_id FROM normal WHERE nl <> '' GROUP BY nl HAVING count(DISTINCT source) >= 10),
cleaned AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE b.nl IS NULL OR b.first_id = n.doc_id) AS new_text
  FROM normal n LEFT JOIN boiler b ON n.nl = b.nl GROUP BY n.doc_id)
SELECT d.doc_id, c.new_text AS text, d.lang, d.source, d.n_chars
FROM documents d JOIN cleaned c USING (doc_id) WHERE regexp_matches(c.new_text, '\S')
"""
