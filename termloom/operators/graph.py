"""Links, crawls over page snapshots, and link analysis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.functions import urls
from termloom.operators import ranks
from termloom.session import materialize, release

HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def raw_links(pages: DataFrame) -> DataFrame:
    """(url, pos, href) of all anchors but blank, fragment and script ones."""
    found = pages.select("url", F.posexplode(F.regexp_extract_all(tx.without_scripts(F.col("html")), F.lit(HREF), F.lit(1))).alias("pos", "h"))
    href = F.trim(tx.decoded(F.regexp_replace("h", "^[\"']|[\"']$", "")))
    return found.select("url", "pos", href.alias("href")).filter((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.col("href").startswith("javascript:"))


def links(pages: DataFrame, rooted_only: bool = False) -> DataFrame:
    """(src, pos, dst): resolved, normalised links to http hosts of two labels or more; duplicates stay."""
    found = raw_links(pages).withColumn("dst", urls.resolve_rooted(F.col("url"), F.col("href")))
    if not rooted_only:  # only relative references and dots in paths go through Python
        plain = urls.is_plain(F.col("url"), F.col("href"))
        hard = found.filter(~plain).withColumn("dst", urls.resolve(F.col("url"), F.col("href")))
        found = found.filter(plain).union(hard)
    out = found.select(F.col("url").alias("src"), "pos", urls.normal_url(F.col("dst")).alias("dst"))
    return out.filter(F.col("dst").rlike("^https?://") & urls.is_valid(F.col("dst")))


def open_graph(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, is_seed, degree_out, degree_in) of the ends of distinct edges(src, dst) and the seeds(url)."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1))).union(seeds.select("url", F.lit(0), F.lit(0)))
    out = ends.groupBy("url").agg(F.sum("o").alias("degree_out"), F.sum("i").alias("degree_in"))
    return out.join(seeds.select("url", F.lit(True).alias("s")).distinct(), "url", "left").select("url", F.coalesce("s", F.lit(False)).alias("is_seed"), "degree_out", "degree_in")


def closed_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between crawled nodes(url), without loops."""
    e = edges.select("src", "dst").distinct().filter("src <> dst")
    inside = e.join(nodes.select(F.col("url").alias("src")).distinct(), "src", "left_semi")
    return inside.join(nodes.select(F.col("url").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


#: Numbers of a block of sums, and edges of a stored chunk.
SPAN, CHUNK = 1 << 14, 1 << 17


class Packed:
    """A graph with its nodes(url, id) numbered from 0 and its distinct edges as chunks of numbers, for sums over neighbours.

    Edges are joined with the numbers once. A step then reads 8 bytes an edge (16 beyond 2^31 nodes) and shuffles nothing: a vector over the nodes, 8 bytes each, is sent
    to all tasks, and the sums come back by blocks. So the driver holds a few vectors, and the edges stay where they are.
    Edges from other nodes don't count; those to others count in the degree alone.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes = materialize(ranks.in_order(nodes.select("url").distinct(), ["url"], "id").select("url", (F.col("id") - 1).alias("id")), "nodes")
        self.spark, self.n = self.nodes.sparkSession, self.nodes.count()
        number = lambda end, name: self.nodes.select(F.col("url").alias(end), F.col("id").alias(name))
        # one exchange by dst serves the distinct rows and the join; the last join is by src, so that degrees are counted where edges lie
        e = edges.select("src", "dst").repartition("dst").distinct().join(number("dst", "d"), "dst", "left")
        self.pairs = materialize(e.join(number("src", "s"), "src").select("s", "d"), "pairs")
        self.width, self._chunks = np.int32 if self.n < 1 << 31 else np.int64, {}

    def degrees(self) -> np.ndarray:
        """Edges from each node."""
        got = self.pairs.groupBy("s").agg(F.count("*").alias("n")).toArrow()
        out = np.zeros(self.n)
        out[got["s"].to_numpy()] = got["n"].to_numpy()
        return out

    def chunks(self, key: str) -> DataFrame:
        """Edges by blocks of one end: rows (into, off), numbers of this end and of the other as bytes, in the order of the first."""
        if key not in self._chunks:
            rows = self.pairs.filter("d is not null").select(F.col(key).alias("into"), F.col("s" if key == "d" else "d").alias("off"))
            self._chunks[key] = materialize(rows.repartition(F.floor(F.col("into") / SPAN)).mapInArrow(_packer(self.width), "into binary, off binary"), "chunks")
        return self._chunks[key]

    def sums(self, vector: np.ndarray, key: str) -> np.ndarray:
        """For each node the sum of vector over the other ends of its edges; key: d for edges to it, s for edges from it."""
        sent, width = self.spark.sparkContext.broadcast(vector), self.width

        def run(batches):
            held = {}
            for batch in batches:
                for into, off in zip(batch.column("into"), batch.column("off")):
                    into, values = np.frombuffer(into.as_buffer(), width), sent.value[np.frombuffer(off.as_buffer(), width)]
                    cuts = np.arange(into[0] // SPAN, into[-1] // SPAN + 1)
                    at = np.searchsorted(into, np.append(cuts, cuts[-1] + 1) * SPAN)
                    for blk, i, j in zip(cuts.tolist(), at, at[1:]):
                        if i < j:
                            got = np.bincount(into[i:j] - blk * SPAN, values[i:j], SPAN)
                            held[blk] = held[blk] + got if blk in held else got
            for blk, got in held.items():
                yield pa.RecordBatch.from_pydict({"blk": pa.array([blk], pa.int64()), "got": pa.array([got.tobytes()], pa.binary())})

        out = np.zeros(-(-self.n // SPAN) * SPAN)
        got = self.chunks(key).mapInArrow(run, "blk long, got binary").toArrow()
        for blk, part in sorted(zip(got["blk"].to_pylist(), got["got"].to_pylist())):
            out[blk * SPAN : (blk + 1) * SPAN] += np.frombuffer(part)
        sent.unpersist()
        return out[: self.n]

    def table(self, **vectors: np.ndarray) -> DataFrame:
        """(url, and a column for each vector)"""
        sent = self.spark.sparkContext.broadcast(vectors)

        def run(batches):
            for batch in batches:
                ids = batch.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("url"), *[pa.array(v[ids]) for v in sent.value.values()]], names=["url", *sent.value])

        return self.nodes.mapInArrow(run, "url string, " + ", ".join(f"{c} double" for c in vectors))

    def release(self) -> None:
        """Delete the stored edges; the nodes stay for table()."""
        release(self.pairs, *self._chunks.values())


def _packer(width: type):
    """A mapInArrow function from rows (into, off) to chunks of CHUNK edges, sorted by into within each."""

    def flush(held):
        into, off = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.argsort(into, kind="stable")
        return pa.RecordBatch.from_pydict({k: pa.array([x[order].astype(width).tobytes()], pa.binary()) for k, x in (("into", into), ("off", off))})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("into").to_numpy(), batch.column("off").to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 100, tol: float | None = 1e-6, packed: Packed | None = None) -> DataFrame:
    """(url, pagerank): power iteration; the mass of nodes without links is spread evenly.

    Stops when the ranks' total change is below tol a node; tol=None makes all steps. packed: the same graph, if it is packed already.
    """
    g = packed or Packed(nodes, edges)
    if not g.n:
        return g.nodes.select("url", F.lit(0.0).alias("pagerank"))
    degree = g.degrees()
    leaf, rank = degree == 0, np.full(g.n, 1.0 / g.n)
    for _ in range(steps):
        new = (1 - damping) / g.n + damping * (g.sums(rank / np.maximum(degree, 1), "d") + rank[leaf].sum() / g.n)
        change, rank = np.abs(new - rank).sum(), new
        if tol is not None and change < g.n * tol:
            break
    if packed is None:
        g.release()
    return g.table(pagerank=rank)


def hits(nodes: DataFrame, edges: DataFrame, steps: int = 100, tol: float | None = 1e-8, packed: Packed | None = None) -> DataFrame:
    """(url, authority, hub): power iteration, each summing to 1; all 0 without edges. packed: the same graph, if it is packed already."""
    g = packed or Packed(nodes, edges)

    def scaled(v: np.ndarray) -> np.ndarray:
        total = v.sum()
        return v / total if total > 0 else np.zeros(g.n)

    authority = np.ones(g.n)
    for _ in range(steps if g.n else 0):
        new = scaled(g.sums(scaled(g.sums(authority, "s")), "d"))
        change, authority = np.abs(new - authority).sum(), new
        if tol is not None and change < tol:
            break
    hub = scaled(g.sums(authority, "s")) if g.n else authority
    if packed is None:
        g.release()
    return g.table(authority=authority, hub=hub)


def rank_overlap(scored: DataFrame, a: str, b: str) -> DataFrame:
    """(k, overlap): percentage that the first k by a and the first k by b have in common; ties by url."""
    numbered = lambda c, name: ranks.in_order(scored.select("url", F.round(c, 12).alias("v")), [F.desc("v"), "url"], name).select("url", name)
    ra, rb = numbered(a, "ra"), numbered(b, "rb")
    entries = ra.join(rb, "url").groupBy(F.greatest("ra", "rb").alias("k")).agg(F.count("*").alias("n"))
    every = ra.select(F.col("ra").alias("k")).join(entries, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))
    done = ranks.running(every, "n", "k", ["k"], "total")
    return done.select("k", F.round(100.0 * F.col("total") / F.col("k"), 6).alias("overlap"))


# Crawls. The driver runs the levels; each is a few joins with the snapshot, written to the shared folder.


def _first(df: DataFrame) -> DataFrame:
    """Of rows (url, ord) the first of each url."""
    return df.groupBy("url").agg(F.min("ord").alias("ord"))


def _links_of(batch: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetched pages (url, ord), and their links (src, ord of the page and link, dst)."""
    got = batch.select("url", "ord").join(pages.groupBy(urls.normal_url(F.col("url")).alias("url")).agg(F.min_by("html", F.struct("url", "html")).alias("html")), "url").filter("html is not null")
    out = links(got.select("url", "html")).withColumnRenamed("src", "url").join(got.select("url", "ord"), "url")
    return got.select("url", "ord"), out.select(F.col("url").alias("src"), F.array(F.col("ord"), F.col("pos").cast("bigint")).alias("at"), "dst")


def _numbered(df: DataFrame) -> DataFrame:
    """A frontier (url, ord) in the order of at, then url, of any size."""
    return ranks.in_order(df.select("url", "at"), ["at", "url"], "ord").select("url", F.col("ord").cast("bigint").alias("ord"))


def crawl(
    seeds: DataFrame, pages: DataFrame, per_site: int | None = 30, max_logical: int = 3, max_physical: int | None = 3, one_domain: bool = False, max_pages: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visited, edges, counters) of a breadth-first crawl of a snapshot pages(url, html) from seeds(url, ord).

    visited(url, ord, logical, fetched): a page that isn't in the snapshot counts as failed. edges(src, dst): all links
    of fetched pages, in one_domain crawls those within it. counters: per level, ok, failed, links, same_domain, queued, filtered.

    per_site: attempts a domain, in frontier order. max_physical: depth of the paths of queued links. max_pages: a cap on
    successes; what a level leaves over goes before newly found links, and depth isn't limited by quota then.
    """
    spark = seeds.sparkSession
    front = _first(seeds.select(urls.normal_url(F.col("url")).alias("url"), F.col("ord").cast("bigint").alias("ord")))
    front = materialize(front, "frontier")
    home = front.agg(F.min_by(urls.domain(F.col("url")), "ord")).first()[0] if one_domain else None
    seen, used = front.select("url"), spark.createDataFrame([], "site string, used long")
    visited, edges, counters, level, ok_total = [], [], [], 0, 0
    while level <= max_logical and front.limit(1).count() and (max_pages is None or ok_total < max_pages):
        sited = front.withColumn("site", urls.domain(F.col("url"))).join(used, "site", "left")
        if per_site is not None:
            sited = sited.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("ord")) + F.coalesce("used", F.lit(0))).filter(F.col("k") <= per_site)
        batch = materialize(sited.select("url", "ord", "site"), "batch")
        carry = None
        if max_pages is not None:
            cut = batch.orderBy("ord").limit(max_pages - ok_total)
            cut = materialize(cut, "batch")
            carry, batch = materialize(batch.join(cut.select("url"), "url", "left_anti"), "carry"), cut
        used = materialize(used.union(batch.groupBy("site").agg(F.count("*").alias("used"))).groupBy("site").agg(F.sum("used").alias("used")), "used")
        got, out = _links_of(batch, pages)
        got, out = materialize(got, "fetched"), materialize(out.withColumn("site", urls.domain(F.col("dst"))), "links")
        inside = out.filter(F.col("site") == home) if one_domain else out
        visited.append(batch.select("url", "ord").join(got.select("url", F.lit(True).alias("fetched")), "url", "left").select("url", "ord", F.lit(level).alias("logical"), F.coalesce("fetched", F.lit(False)).alias("fetched")))
        edges.append(inside.select("src", "dst"))
        passes = F.lit(True)
        if max_physical is not None:
            passes = passes & (urls.physical_depth(F.col("url")) <= max_physical)
        if one_domain:
            passes = passes & (F.col("site") == home)
        fresh = out.select(F.col("dst").alias("url"), "site", "at").join(seen, "url", "left_anti").join(used, "site", "left")
        if per_site is not None:
            passes = passes & (F.coalesce("used", F.lit(0)) < per_site)
        fresh = fresh.withColumn("ok", passes)
        queue = level < max_logical
        new = fresh.filter("ok").groupBy("url").agg(F.min("at").alias("at")) if queue else fresh.limit(0).select("url", "at")
        new = materialize(new, "found")
        ok_count = got.count()
        counters.append((level, ok_count, batch.count() - ok_count, out.count(), inside.count() if one_domain else None, new.count(), fresh.filter("not ok").count() if queue else 0))
        ok_total += ok_count
        following = _numbered(new)
        if carry is not None:
            following = _numbered(carry.select("url", F.array(F.lit(0).cast("bigint"), "ord").alias("at")).union(new.select("url", F.concat(F.array(F.lit(1).cast("bigint")), "at"))))
        front, seen, level = materialize(following, "frontier"), materialize(seen.union(new.select("url")), "seen"), level + 1

    def union(parts: list[DataFrame], schema: str) -> DataFrame:
        out = spark.createDataFrame([], schema)
        for p in parts:
            out = out.union(p)
        return out

    done = union(visited, "url string, ord long, logical int, fetched boolean")
    table = spark.createDataFrame(counters, "level int, ok long, failed long, links long, same_domain long, queued long, filtered long")
    return done, union(edges, "src string, dst string"), table
