"""Readers of text collections, judgements, queries and posting dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_collection(spark: SparkSession, folder: str, recursive: bool = True, pattern: str = "*.{txt,html,htm}") -> DataFrame:
    """(path, text): one row a file; bytes that aren't UTF-8 are dropped."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"))


def numbered_by_path(collection: DataFrame, first: int = 0) -> DataFrame:
    """doc_id in the order of paths; folders are numbered side by side, so that no task sorts all files."""
    from termloom.operators.ranks import numbered

    with_folder = collection.withColumn("__folder", F.regexp_replace("path", "[^/]*$", ""))
    out = numbered(with_folder, [F.col("__folder")], ["path"], "doc_id").drop("__folder")
    return out.select((F.col("doc_id") - 1 + first).alias("doc_id"), "path", "text")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def read_expected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(n_docs, n_tokens, n_terms) and (term, df) of a file of expected statistics."""
    raw = spark.read.schema("statistics struct<N:long,num_tokens:long,num_terms:long>, data array<struct<term:string,df:long>>").json(path, multiLine=True)
    return raw.select("statistics.*").toDF("n_docs", "n_tokens", "n_terms"), raw.select(F.explode("data").alias("d")).select("d.term", "d.df")


def _tag(text: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1))


def read_trec_documents(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text) of DOC blocks, tags in any case; those without DOCNO are skipped; TEXT if there is one, else the block without tags, blanks collapsed."""
    parts = spark.read.text(path, lineSep="</DOC>").select(F.explode(F.split("value", "(?i)</doc>")).alias("value"))
    blocks = parts.select(F.regexp_extract("value", r"(?is)<doc\b[^>]*>(.*)$", 1).alias("b"))
    inner = _tag(F.col("b"), "text")
    whole = F.regexp_replace(F.regexp_replace("b", r"(?is)<docno\b[^>]*>.*?</docno\s*>", " "), "(?s)<[^>]*>", " ")
    text = F.trim(F.regexp_replace(F.when(inner != "", F.regexp_replace(inner, "(?s)<[^>]*>", " ")).otherwise(whole), r"\s+", " "))
    return blocks.select(_tag(F.col("b"), "docno").alias("docno"), text.alias("text")).filter("docno <> ''")


def read_trec_text(spark: SparkSession, path: str) -> DataFrame:
    """(text) of DOC blocks in capitals, without DOCNO, other tags kept; a file without such blocks is one text."""
    files = spark.read.text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit("(?s)<DOC>(.*?)</DOC>"), F.lit(1))
    texts = files.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array("value"))).alias("text"))
    return texts.select(F.regexp_replace("text", "(?s)<DOCNO>.*?</DOCNO>", "").alias("text"))


def read_language_training(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(lang, text): one text a language, from a file each."""
    out = None
    for lang, path in files.items():
        part = spark.read.text(path, wholetext=True).select(F.lit(lang).alias("lang"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"))
        out = part if out is None else out.union(part)
    return out


def read_query_groups(spark: SparkSession, path: str, vocabulary: DataFrame) -> DataFrame:
    """(n_terms, terms, postings) of a file of queries, terms between blanks a line: those all of whose terms vocabulary(term, df) has, with the sum of df."""
    lines = spark.read.text(path).select(F.filter(F.split(F.lower(F.trim("value")), r"\s+"), lambda x: x != "").alias("terms")).filter(F.size("terms") > 0)
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    sums = lines.select("id", "terms", F.explode("terms").alias("term")).join(vocabulary.select("term", "df"), "term", "left").groupBy("id", "terms").agg(F.count("df").alias("n"), F.sum("df").alias("postings"))
    return sums.filter(F.col("n") == F.size("terms")).select(F.size("terms").alias("n_terms"), "terms", "postings")


def parse_trec_queries(text: str) -> list[tuple[str, str]]:
    """(qid, query) of a topics file, which is small: top blocks, else DOC blocks, else .I and .W."""
    import re

    def tag(block: str, name: str, stop: str = r"<|$") -> str:
        m = re.search(rf"(?is)<{name}>\s*(?:{name}\w*:|number:|description:)?\s*(.*?)\s*(?=</{name}>|{stop})", block)
        return " ".join(m[1].split()) if m else ""

    tops = [(tag(b, "num"), tag(b, "title") or tag(b, "desc")) for b in re.findall(r"(?is)<top>(.*?)</top>", text)]
    if tops:
        return [t for t in tops if t[0]]
    docs = [(tag(b, "docno"), " ".join(re.sub(r"(?is)<docno>.*?</docno>|<[^>]*>", " ", b).split())) for b in re.findall(r"(?is)<doc>(.*?)</doc>", text)]
    if docs:
        return [d for d in docs if d[0]]
    return [(i, " ".join(w.split())) for i, w in re.findall(r"(?ms)^\.I\s+(\S+)\s*^\.W\s*(.*?)(?=^\.I\s|\Z)", text)]


def read_trec_queries(spark: SparkSession, path: str) -> DataFrame:
    row = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse_trec_queries(row["value"] if row else ""), "qid string, query string")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, label): of four or more fields the first, third and fourth; of three, all; other lines are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f"), F.size(f).alias("n")).filter("n >= 3")
    four = F.col("n") >= 4
    label = F.when(four, F.get("f", F.lit(3))).otherwise(F.get("f", F.lit(2))).try_cast("double").cast("int")
    return rows.select(F.col("f")[0].alias("qid"), F.when(four, F.col("f")[2]).otherwise(F.col("f")[1]).alias("docno"), label.alias("label")).filter("label is not null")


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """(qid, terms) of lines id:text or text, in lower case; a line without id has the number of queries so far. A log is read whole in one task, as its numbers need."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    has_id = F.col("line").contains(":")
    body = F.when(has_id, F.regexp_replace("line", "^[^:]*:", "")).otherwise(F.col("line"))
    kept = lines.select("i", F.when(has_id, F.trim(F.substring_index("line", ":", 1))).alias("id"), F.filter(F.split(F.lower(F.trim(body)), r"\s+"), lambda x: x != "").alias("terms"))
    kept = kept.filter(F.size("terms") > 0).withColumn("k", F.row_number().over(Window.orderBy("i")))
    return kept.select(F.coalesce("id", F.col("k").cast("string")).alias("qid"), "terms")


def read_posting_dump(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, docids) of lines term:df:id,id, ; the stored df is ignored, ids that aren't numbers and lines without ids are skipped; of a term that repeats the last line stays."""
    f = F.split(F.trim("value"), ":")
    ids = F.array_sort(F.filter(F.transform(F.split(F.element_at(f, 3), ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull()))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.text(path).select("value", place.alias("at")).filter(F.size(f) >= 3).select(f[0].alias("term"), ids.alias("docids"), "at").filter(F.size("docids") > 0)
    return rows.groupBy("term").agg(F.max_by("docids", "at").alias("docids")).select("term", F.size("docids").alias("df"), "docids")


def read_language_test(spark: SparkSession, lines: str, solution: str) -> DataFrame:
    """(line_no, text, truth): lines and the second fields of a solution, by position; shorter solution lines don't count."""
    def placed(path: str) -> DataFrame:
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))

    truth = placed(solution).select("line_no", F.split(F.trim("text"), r"\s+").alias("f")).filter(F.size("f") >= 2)
    truth = truth.agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("f")[1].alias("lang")))).alias("t")).select(F.posexplode("t").alias("line_no", "x")).select("line_no", F.col("x.lang").alias("truth"))
    return placed(lines).filter("trim(text) <> ''").join(truth, "line_no")
