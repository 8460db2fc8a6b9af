"""Quality rule on line frequency: lines that many documents of one host share are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.lines import keep_lines, line_hashes


def line_frequency_rule(docs: DataFrame, max_docs: int = 20, min_kept: float = 0.3, host_col: str = "source") -> DataFrame:
    """Remove the lines that more than max_docs distinct documents of a host have; reject what is depleted.

    Lines are compared in normal form (lower case, white space collapsed) by a 64-bit hash. A document is
    rejected if less than min_kept of its characters are left, or none that isn't white space.
    Returns the accepted rows with all their columns, text without the removed lines, and n_removed,
    the number of distinct removed lines (an input column of that name is replaced).

    Null or empty texts: rejected. Null host: a host of its own. Null doc_id: one document.
    Repeated rows count as one document, and each stays. An empty table gives an empty table.
    Only line hashes are shuffled, and the documents once, by doc_id.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))  # no name of docs can clash
    row = F.col("__row")
    lines = rows.select(row["doc_id"].alias("__d"), row[host_col].alias("__h"), F.explode(line_hashes(row["text"])).alias("__l"))
    # coalesced: a null document counts as one
    key = F.coalesce(F.col("__d").cast("string"), F.lit(""))
    common = lines.groupBy("__h", "__l").agg(F.count_distinct(key).alias("__n")).filter(F.col("__n") > max_docs).select(F.col("__h").alias("__ch"), F.col("__l").alias("__cl"))
    hits = lines.join(common, F.col("__h").eqNullSafe(F.col("__ch")) & (F.col("__l") == F.col("__cl")))
    # repeated rows of a document may name several hosts: the host is part of the key
    dropped = hits.groupBy(F.col("__d").alias("__dd"), F.col("__h").alias("__dh")).agg(F.collect_set("__l").alias("__dropped"))
    out = rows.join(dropped, row["doc_id"].eqNullSafe(F.col("__dd")) & row[host_col].eqNullSafe(F.col("__dh")), "left")
    out = out.withColumn("__text", keep_lines(row["text"], F.col("__dropped")))
    enough = (F.length("__text") >= min_kept * F.length(row["text"])) & F.col("__text").rlike(r"\S")
    cols = [F.col("__text").alias("text") if c == "text" else row[c].alias(c) for c in docs.columns if c != "n_removed"]
    return out.filter(enough).select(*cols, F.coalesce(F.size("__dropped"), F.lit(0)).cast("bigint").alias("n_removed"))


def op2_line_quality(spark, sf_dir: str) -> DataFrame:
    return line_frequency_rule(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "text", "n_removed")


def line_quality_low_limit(spark, sf_dir: str) -> DataFrame:
    """The same with a limit of two documents, which small tables pass too."""
    return line_frequency_rule(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_docs=2).select("doc_id", "source", "text", "n_removed")


SQL_OP2 = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
normal AS (SELECT doc_id, source, pos, line, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS nl FROM lines),
common AS (SELECT source, nl FROM normal WHERE nl <> '' GROUP BY source, nl HAVING count(DISTINCT doc_id) > 20),
marked AS (SELECT n.*, c.nl IS NOT NULL AS gone FROM normal n LEFT JOIN common c ON n.source IS NOT DISTINCT FROM c.source AND n.nl = c.nl),
cleaned AS (
  SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS new_text,
         count(DISTINCT nl) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY doc_id, source)
SELECT d.doc_id, d.source, c.new_text AS text, CAST(c.n_removed AS BIGINT) AS n_removed
FROM documents d JOIN cleaned c USING (doc_id)
WHERE length(c.new_text) >= 0.3 * length(d.text) AND regexp_matches(c.new_text, '\S')
"""
SQL_LOW_LIMIT = SQL_OP2.replace("> 20", "> 2")
