"""Inverted index: blocks of postings, a stored index and its reader, offsets, skip lists and codecs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import codecs
from termloom.operators import corpus, ranks

#: Postings of a term go to blocks by ranges of so many doc_ids, so that a frequent term is many rows and no task sorts a whole list.
BLOCK = 1 << 16


def term_frequencies(docs: DataFrame, analyzer=None) -> DataFrame:
    """(doc_id, term, tf) of valid terms, or of those that an analyzer makes of docs as (doc_id, pos, term)."""
    return corpus.term_frequency(analyzer(docs) if analyzer else corpus.valid(corpus.tokens(docs)))


def vocabulary(tf: DataFrame) -> DataFrame:
    """(term_id, term, df, cf), numbered alphabetically."""
    return ranks.term_ids(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))


def _block(width: int):
    return F.floor(F.col("doc_id") / width).alias("blk")


def posting_blocks(tf: DataFrame, width: int = BLOCK) -> DataFrame:
    """(term, blk, df, cf, postings): the postings of a term in a range of doc_ids, sorted; df and cf are the block's."""
    rows = tf.select("term", _block(width), "doc_id", "tf").groupBy("term", "blk")
    return rows.agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"), F.count("*").alias("df"), F.sum("tf").alias("cf")).select("term", "blk", "df", "cf", "postings")


def placed(tf: DataFrame, width: int = BLOCK) -> DataFrame:
    """tf with blk, k (place in the block, from 0), before (postings in earlier blocks), carry (the last doc_id of these, or null) and df.

    Only the sizes of a term's blocks meet in one task, and the postings of one block.
    """
    rows = tf.select("term", _block(width), "doc_id", "tf")
    term, earlier = Window.partitionBy("term"), Window.partitionBy("term").orderBy("blk")
    sizes = rows.groupBy("term", "blk").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    sizes = sizes.select(
        "term", "blk", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("last").over(earlier).alias("carry"), F.sum("n").over(term).alias("df"),
    )
    here = Window.partitionBy("term", "blk").orderBy("doc_id")
    return rows.join(sizes, ["term", "blk"]).withColumn("k", (F.row_number().over(here) - 1).cast("bigint"))


def _lists(tf: DataFrame, width: int) -> DataFrame:
    """(term, blk, docs, tfs), as in a stored index."""
    return posting_blocks(tf, width).select("term", "blk", F.transform("postings", lambda p: p["doc_id"]).alias("docs"), F.transform("postings", lambda p: p["tf"]).alias("tfs"))


def carried(blocks: DataFrame) -> DataFrame:
    """blocks(term, blk, docs, ..) with carry, the last doc_id of the term's block before, or 0: a block stays a row, and of other blocks only that number is sent."""
    last = blocks.select("term", "blk", F.element_at("docs", -1).alias("last"))
    carry = last.select("term", "blk", F.lag("last").over(Window.partitionBy("term").orderBy("blk")).alias("carry")).filter("carry is not null")
    return blocks.join(carry, ["term", "blk"], "left").withColumn("carry", F.coalesce("carry", F.lit(0)))


def gap_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(term, blk, docs, ..) with gaps: the first doc_id of a term, then differences, also from block to block."""
    before = F.concat(F.array("carry"), F.slice("docs", 1, F.size("docs") - 1))
    return carried(blocks).withColumn("gaps", F.zip_with("docs", before, lambda d, b: d - b))


def gap_rows(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf, gap) of blocks(term, blk, docs, tfs)."""
    # outer, since else the lists would be made a second time for a filter; they are never empty
    rows = gap_blocks(blocks.select("term", "blk", "docs", "tfs")).select("term", F.explode_outer(F.arrays_zip("docs", "tfs", "gaps")).alias("p"))
    return rows.select("term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").cast("bigint").alias("tf"), F.col("p.gaps").alias("gap"))


def gaps(tf: DataFrame, width: int = BLOCK) -> DataFrame:
    """(term, doc_id, tf, gap): the first doc_id, then differences, also from block to block."""
    return gap_rows(_lists(tf, width))


def gap_rows_inverse(blocks: DataFrame) -> DataFrame:
    """(term, doc_id) of blocks(term, blk, gaps): running sums over blocks and within them."""
    sums = blocks.select("term", "blk", F.aggregate("gaps", F.lit(0).cast("bigint"), lambda s, g: s + g).alias("s"))
    before = F.sum("s").over(Window.partitionBy("term").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("term", "blk", before.alias("before")).filter("before is not null")
    rows = blocks.select("term", "blk", "gaps").join(sums, ["term", "blk"], "left").select("term", F.coalesce("before", F.lit(0)).alias("before"), "gaps")
    return rows.mapInArrow(codecs.running_lists, "term string, docs array<long>").select("term", F.explode("docs").alias("doc_id"))


def gaps_inverse(gapped: DataFrame, width: int = BLOCK) -> DataFrame:
    """doc_ids again, as running sums over blocks and within them; the order is that of doc_id, which a stored list has by itself."""
    lists = gapped.select("term", _block(width), "doc_id", "gap").groupBy("term", "blk").agg(F.array_sort(F.collect_list(F.struct("doc_id", "gap"))).alias("p"))
    return gap_rows_inverse(lists.select("term", "blk", F.transform("p", lambda p: p["gap"]).alias("gaps")))


def skip_list(tf: DataFrame, width: int = BLOCK) -> DataFrame:
    """(term, doc_id, idx): every floor(sqrt(df))-th posting, none for lists of one."""
    pos = placed(tf, width).withColumn("idx", F.col("before") + F.col("k"))
    return pos.filter((F.col("df") > 1) & (F.col("idx") % F.greatest(F.lit(1), F.floor(F.sqrt("df"))) == 0)).select("term", "doc_id", "idx")


def skip_segments(tf: DataFrame, width: int = BLOCK) -> DataFrame:
    """(term, df, seg, low, high, docs): the postings between two skips, sorted, with their first and last doc_id.

    A skip lies at every floor(sqrt(df))-th posting; a segment is a row, so that an intersection can pass over it unread.
    """
    pos = placed(tf, width).withColumn("seg", F.floor((F.col("before") + F.col("k")) / F.greatest(F.lit(1), F.floor(F.sqrt("df")))))
    rows = pos.groupBy("term", "df", "seg").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    return rows.select("term", "df", "seg", F.col("docs")[0].alias("low"), F.element_at("docs", -1).alias("high"), "docs")


def skip_and(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(qid, docs, read, passed) of pairs(qid, short, long): the documents of both terms, and how many segments of the longer list were read and passed over.

    The shorter list is held against the skips of the longer one (low and high of a segment), and the lists of those segments alone are opened in which it has a document.
    """
    short = pairs.join(segments.select(F.col("term").alias("short"), F.explode("docs").alias("doc_id")), "short")
    long = pairs.join(segments.select(F.col("term").alias("long"), "seg", "low", "high"), "long").select("qid", "long", "seg", "low", "high")
    met = short.select("qid", "long", "doc_id").join(long, ["qid", "long"]).filter(F.col("doc_id").between(F.col("low"), F.col("high")))
    asked = met.groupBy("qid", "long", "seg").agg(F.collect_set("doc_id").alias("asked"))
    opened = asked.join(segments.select(F.col("term").alias("long"), "seg", "docs"), ["long", "seg"])
    hits = opened.groupBy("qid").agg(F.sum(F.size(F.array_intersect("docs", "asked"))).cast("bigint").alias("docs"), F.count("*").alias("read"))
    sizes = long.groupBy("qid").agg(F.count("*").alias("n"))
    return pairs.select("qid").join(hits, "qid", "left").join(sizes, "qid", "left").select(
        "qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "read")], (F.coalesce("n", F.lit(0)) - F.coalesce("read", F.lit(0))).alias("passed")
    )


# The stored index


def write_index(docs: DataFrame, path: str, buckets: int | None = None, frequencies: bool = True, analyzer=None, width: int = BLOCK) -> None:
    """Blocks of postings sorted by term, the vocabulary with offsets, and the documents' lengths, as Parquet below path.

    A lookup reads the row groups of its terms. Without frequencies the blocks hold doc_ids alone, as a Boolean index does.
    """
    tf = term_frequencies(docs, analyzer)
    lists = F.transform("postings", lambda p: p["doc_id"]), F.transform("postings", lambda p: p["tf"].cast("int"))
    columns = [lists[0].alias("docs")] + [lists[1].alias("tfs")] * frequencies
    blocks = posting_blocks(tf, width).select("term", "blk", "df", "cf", *columns)
    parted = blocks.repartitionByRange(buckets, "term", "blk") if buckets else blocks.repartitionByRange("term", "blk")
    parted.sortWithinPartitions("term", "blk").write.parquet(f"{path}/postings")
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    vocab = ranks.term_ids(stored.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
    vocab_offsets(vocab, 8 if frequencies else 4, "cf").write.parquet(f"{path}/vocabulary")
    names = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    lengths = _postings(stored, frequencies).groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    docs.select("doc_id", names.alias("name")).join(lengths, "doc_id", "left").select("doc_id", "name", F.coalesce("dl", F.lit(0)).alias("dl")).write.parquet(f"{path}/documents")


def _postings(blocks: DataFrame, frequencies: bool) -> DataFrame:
    if not frequencies:
        return blocks.select("term", F.explode("docs").alias("doc_id")).withColumn("tf", F.lit(1).cast("bigint"))
    return blocks.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("p")).select("term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").cast("bigint").alias("tf"))


@dataclass(frozen=True)
class Stored:
    """A stored index: its tables are read when they are asked for, with the terms as a filter of the scan."""

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def has_frequencies(self) -> bool:
        """Whether the blocks hold frequencies, by their schema."""
        return "tfs" in self.blocks.columns

    @property
    def vocabulary(self) -> DataFrame:
        """(term_id, term, df, cf, seek)"""
        return self.spark.read.parquet(f"{self.path}/vocabulary")

    @property
    def documents(self) -> DataFrame:
        """(doc_id, name, dl)"""
        return self.spark.read.parquet(f"{self.path}/documents")

    def matching(self, terms: list[str] | DataFrame | None = None, pushed: int = 1000) -> DataFrame:
        """Blocks of some terms. A list of up to pushed distinct ones becomes a filter of the scan, more are joined."""
        if terms is None:
            return self.blocks
        if isinstance(terms, DataFrame):
            wanted = terms.select("term").distinct()
            few = [r["term"] for r in wanted.limit(pushed + 1).collect()]
            if len(few) > pushed:
                return self.blocks.join(wanted, "term", "left_semi")
            terms = few
        return self.blocks.filter(F.col("term").isin(sorted(set(terms))))

    def postings(self, terms: list[str] | DataFrame | None = None) -> DataFrame:
        """(term, doc_id, tf); tf is 1 in an index without frequencies."""
        blocks = self.matching(terms)
        return _postings(blocks, "tfs" in blocks.columns)


def lookup(stored: Stored, term: str) -> DataFrame:
    """The postings of a term, in lower case, with the documents' names; a missing one has a placeholder."""
    hits = stored.postings([term.lower()]).select("doc_id", "tf")
    return hits.join(stored.documents.select("doc_id", "name"), "doc_id", "left").select("doc_id", F.coalesce("name", F.lit("?")).alias("name"), "tf")


def vocab_offsets(vocab: DataFrame, record: int = 8, *more: str) -> DataFrame:
    """(term_id, term, df, seek): where each list begins in a file of records in term order."""
    sized = vocab.withColumn("bytes", F.col("df") * record)
    return ranks.running(sized, "bytes", "term_id", ["term_id"], "end").select("term_id", "term", "df", *more, (F.col("end") - F.col("bytes")).alias("seek"))


def compressed(tf: DataFrame, value: str = "gap", width: int = BLOCK) -> DataFrame:
    """(term, blk, n, carry, vbyte, gamma): gaps or doc_ids of a block as VByte, frequencies as gamma, both binary.

    carry is what the first gap is counted from, so that a block can be read without those before.
    """
    return compressed_blocks(_lists(tf, width), value)


def compressed_blocks(blocks: DataFrame, value: str = "gap") -> DataFrame:
    """compressed() of blocks(term, blk, docs, tfs)."""
    lists = carried(blocks.select("term", "blk", "docs", F.transform("tfs", lambda x: x.cast("bigint")).alias("tfs")))
    return lists.select("term", "blk", "carry", "docs", "tfs").mapInArrow(codecs.encode_blocks(value), codecs.BLOCKS)


def write_compressed(tf: DataFrame, path: str, gaps: bool = True, width: int = BLOCK) -> None:
    """Compressed blocks sorted by term, and a vocabulary of (term, df, bytes and offsets of both streams), below path."""
    blocks = compressed(tf, "gap" if gaps else "doc_id", width)
    blocks.repartitionByRange("term", "blk").sortWithinPartitions("term", "blk").write.parquet(f"{path}/blocks")
    stored = tf.sparkSession.read.parquet(f"{path}/blocks")
    sizes = stored.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.octet_length("vbyte")).alias("vbyte_bytes"), F.sum(F.octet_length("gamma")).alias("gamma_bytes"))
    vocab = ranks.term_ids(sizes)
    for stream in ("vbyte", "gamma"):
        size = f"{stream}_bytes"
        vocab = ranks.running(vocab, size, "term_id", ["term_id"], "end").withColumn(f"{stream}_seek", F.col("end") - F.col(size)).drop("end")
    vocab.withColumn("gaps", F.lit(gaps)).write.parquet(f"{path}/vocabulary")


def read_compressed(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf) of a compressed index, of some terms or of all."""
    blocks = spark.read.parquet(f"{path}/blocks")
    first = spark.read.parquet(f"{path}/vocabulary").select("gaps").first()
    return decompress(blocks if terms is None else blocks.filter(F.col("term").isin(terms)), bool(first and first["gaps"]))


def compress_sizes(tf: DataFrame, width: int = BLOCK) -> DataFrame:
    """Bytes of both streams, and their share of eight a posting."""
    return sizes_of(compressed(tf, width=width))


def sizes_of(blocks: DataFrame) -> DataFrame:
    """compress_sizes() of compressed blocks."""
    out = blocks.agg(F.sum(F.octet_length("vbyte")).alias("vbyte_bytes"), F.sum(F.octet_length("gamma")).alias("gamma_bytes"), F.sum("n").alias("postings"))
    return out.withColumn("ratio", F.round((F.col("vbyte_bytes") + F.col("gamma_bytes")) / (8 * F.col("postings")), 6))


def decompress(blocks: DataFrame, gaps: bool = True) -> DataFrame:
    """(term, doc_id, tf) from compressed(): Arrow batches, since gamma codes are read bit by bit."""
    return blocks.select("term", "n", "carry", "vbyte", "gamma").mapInPandas(codecs.decode_blocks(gaps), "term string, doc_id long, tf long")
