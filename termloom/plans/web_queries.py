"""Queries on pages: text of markup, URLs, links, crawls and link analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.functions import urls
from termloom.operators import graph
from termloom.plans.registry import query
from termloom.session import materialize


def _sql_text(html: str) -> str:
    x = rf"regexp_replace({html}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<!--.*?-->|<(?:meta|link)\b[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({_sql_decoded(x)}, '\s+', ' ', 'g'))"


def _sql_decoded(x: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


@query("q_html_clean", f"SELECT page_id, {_sql_text('html')} AS text FROM pages")
def html_clean(t):
    return t("pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


_HEAD = lambda tag: _sql_text(rf"regexp_extract(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)")


@query("q_html_title", f"SELECT page_id, substr(coalesce(nullif({_HEAD('title')}, ''), nullif({_HEAD('h1')}, ''), url), 1, 250) AS title FROM pages")
def html_title(t):
    return t("pages").select("page_id", tx.html_title(F.col("html"), F.col("url")).alias("title"))


_AUTH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_NORMAL = r"regexp_replace(trim({u}), '(?s)#.*$', '')"
_DOMAIN = r"regexp_replace(lower(" + _AUTH + r"), '^www\.', '')"
_VALID = r"regexp_matches(regexp_replace(regexp_replace(" + _AUTH + r", '^.*@', ''), ':.*$', ''), '^[^.]+(\.[^.]+)+$')"
_DEPTH = "len(list_filter(string_split(" + _PATH + ", '/'), lambda x: x <> ''))"
_KIND = (
    r"CASE WHEN regexp_extract({u}, '^[^?#]*\?([^#]*)', 1) <> '' OR regexp_matches(lower(" + _PATH + r"), '[^/.][^/]*\.("
    + "|".join(urls.SCRIPTS) + r")$') THEN 'dynamic' ELSE 'static' END"
)


def at(piece: str, u: str = "url") -> str:
    return piece.replace("{u}", u)


@query("q_url_parts", f"SELECT page_id, {at(_NORMAL)} AS normal, {at(_DOMAIN)} AS domain, CAST({at(_DEPTH)} AS BIGINT) AS depth, {at(_VALID)} AS valid FROM pages")
def url_parts(t):
    u = F.col("url")
    return t("pages").select("page_id", urls.normal_url(u).alias("normal"), urls.domain(u).alias("domain"), urls.physical_depth(u).cast("bigint").alias("depth"), urls.is_valid(u).alias("valid"))


@query("q_url_classify", f"SELECT page_id, {at(_KIND)} AS kind FROM pages")
def url_classify(t):
    return t("pages").select("page_id", urls.kind(F.col("url")).alias("kind"))


@query("q_depth_hist", f"SELECT CAST({at(_DEPTH)} AS BIGINT) AS depth, {at(_KIND)} AS kind, count(*) AS n FROM pages WHERE {at(_DEPTH)} > 0 GROUP BY ALL")
def depth_hist(t):
    u = F.col("url")
    return t("pages").select(urls.physical_depth(u).cast("bigint").alias("depth"), urls.kind(u).alias("kind")).filter("depth > 0").groupBy("depth", "kind").agg(F.count("*").alias("n"))


_NO_SCRIPT = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<!--.*?-->|<(?:meta|link)\b[^>]*>', ' ', 'g')"
_HREFS = r"""regexp_extract_all(""" + _NO_SCRIPT + r""", '(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
RAW = f"""found AS (SELECT url, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT url, {_HREFS} AS hs FROM pages)),
raw AS (SELECT url, pos, trim({_sql_decoded("regexp_replace(h, '^[\"'']|[\"'']$', '', 'g')")}) AS href FROM found),
kept AS (SELECT * FROM raw WHERE href <> '' AND href NOT LIKE '#%' AND href NOT LIKE 'javascript:%')"""
LINKS = f"""{RAW}, joined AS (SELECT url AS src, pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN href LIKE '//%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
  WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || '//' || {at(_AUTH)} || href END AS j FROM kept),
resolved AS (SELECT src, pos, {at(_NORMAL, 'j')} AS dst FROM joined WHERE j IS NOT NULL),
links AS (SELECT * FROM resolved WHERE regexp_matches(dst, '^https?://') AND {at(_VALID, 'dst')})"""


@query("q_links_raw", f"WITH {RAW} SELECT url, pos, href FROM kept")
def links_raw(t):
    return graph.raw_links(t("pages"))


@query("q_links", f"WITH {LINKS} SELECT src, pos, dst FROM links")
def links(t):
    return graph.links(t("pages"))


def seeds(t):
    return t("pages").select(urls.normal_url(F.col("url")).alias("url")).distinct()


SEEDS = f"seeds AS (SELECT DISTINCT {at(_NORMAL)} AS url FROM pages)"
OPEN = f"""{LINKS}, {SEEDS}, e AS (SELECT DISTINCT {at(_NORMAL, 'src')} AS src, dst FROM links), nodes AS (SELECT src AS url FROM e UNION SELECT dst FROM e UNION SELECT url FROM seeds)"""


def open_edges(t):
    return graph.links(t("pages")).select(urls.normal_url(F.col("src")).alias("src"), "dst").distinct()


@query(
    "q_graph_open",
    f"""WITH {OPEN} SELECT n.url, n.url IN (SELECT url FROM seeds) AS is_seed, coalesce(o.c, 0) AS degree_out, coalesce(i.c, 0) AS degree_in
FROM nodes n LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY src) o ON o.src = n.url LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) i ON i.dst = n.url""",
)
def graph_open(t):
    return graph.open_graph(open_edges(t), seeds(t))


# The graph of the parts and suppliers of lineitem, both ways: closed, and large enough for link analysis


def supply_edges(t):
    keys = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    out = keys.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return out.union(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def supply_nodes(edges):
    """Each node of the supply graph is the source of an edge."""
    return edges.select(F.col("src").alias("url")).distinct()


def ends(edges):
    return edges.select(F.col("src").alias("url")).union(edges.select("dst")).distinct()


SUPPLY = """pe AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), e AS MATERIALIZED (SELECT src, dst FROM pe UNION ALL SELECT dst, src FROM pe),
nodes AS MATERIALIZED (SELECT DISTINCT src AS url FROM e)"""


@query(
    "q_graph_closed",
    f"WITH {LINKS}, {SEEDS}, e AS (SELECT DISTINCT {at(_NORMAL, 'src')} AS src, dst FROM links) SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT url FROM seeds) AND dst IN (SELECT url FROM seeds)",
)
def graph_closed(t):
    return graph.closed_graph(open_edges(t), seeds(t))


STEPS = 8


def pagerank_sql(steps: int = STEPS) -> str:
    parts = ["size AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "deg AS (SELECT src, count(*) AS deg FROM e GROUP BY src)", "r0 AS MATERIALIZED (SELECT url, 1 / n AS r FROM nodes, size)"]
    for k in range(steps):
        parts.append(
            f"""r{k + 1} AS MATERIALIZED (SELECT nodes.url, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + loose / n) AS r FROM nodes
LEFT JOIN (SELECT e.dst, sum(r / deg) AS got FROM e JOIN deg USING (src) JOIN r{k} ON r{k}.url = e.src GROUP BY e.dst) s ON s.dst = nodes.url, size,
(SELECT coalesce(sum(r), 0) AS loose FROM r{k} WHERE url NOT IN (SELECT src FROM deg)))"""
        )
    return ", ".join(parts)


def hits_sql(steps: int = STEPS) -> str:
    parts = ["a0 AS MATERIALIZED (SELECT url, 1::DOUBLE AS v FROM nodes)"]
    one = lambda name, of, near, far: (
        f"{name} AS MATERIALIZED (WITH x AS (SELECT nodes.url, coalesce(s.v, 0) AS v FROM nodes LEFT JOIN (SELECT e.{near} AS url, sum(v) AS v FROM e JOIN {of} o ON o.url = e.{far} GROUP BY e.{near}) s USING (url)) "
        "SELECT url, CASE WHEN t > 0 THEN v / t ELSE 0 END AS v FROM x, (SELECT sum(v) AS t FROM x))"
    )
    for k in range(steps):
        parts += [one(f"h{k}", f"a{k}", "src", "dst"), one(f"a{k + 1}", f"h{k}", "dst", "src")]
    return ", ".join([*parts, one("h_end", f"a{steps}", "src", "dst")])


@query("q_pagerank", f"WITH {OPEN}, {pagerank_sql()} SELECT url, round(r, 8) AS pagerank FROM r{STEPS}")
def pagerank(t):
    """Of the open graph of pages, a fixed number of steps."""
    edges = open_edges(t)
    return graph.pagerank(ends(edges).union(seeds(t)), edges, steps=STEPS, tol=None).withColumn("pagerank", F.round("pagerank", 8))


@query("q_pagerank_supply", f"WITH {SUPPLY}, {pagerank_sql()} SELECT url, round(r, 8) AS pagerank FROM r{STEPS}")
def pagerank_supply(t):
    edges = materialize(supply_edges(t), "supply")
    return graph.pagerank(supply_nodes(edges), edges, steps=STEPS, tol=None).withColumn("pagerank", F.round("pagerank", 8))


#: On the supply graph rank swings between the two sides, and STEPS steps are far from the end. The tolerance is a thousandth of the operator's:
#: of 20,000 nodes, a millionth each would be 2 % of all rank.
END = {"steps": 200, "tol": 1e-9}


@query("q_pagerank_supply_converged")
def pagerank_supply_converged(t):
    """q_pagerank_supply iterated to convergence, which SQL of a fixed number of steps can't repeat."""
    edges = materialize(supply_edges(t), "supply")
    return graph.pagerank(supply_nodes(edges), edges, **END).withColumn("pagerank", F.round("pagerank", 8))


@query("q_hits", f"WITH {OPEN}, {hits_sql()} SELECT url, round(a{STEPS}.v, 6) AS authority, round(h_end.v, 6) AS hub FROM a{STEPS} JOIN h_end USING (url)")
def hits(t):
    edges = open_edges(t)
    return graph.hits(ends(edges).union(seeds(t)), edges, steps=STEPS, tol=None).select("url", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@query(
    "q_rank_overlap",
    f"""WITH {SUPPLY}, {pagerank_sql()}, {hits_sql()},
o AS (SELECT url, row_number() OVER (ORDER BY round(r, 12) DESC, url) AS ra, row_number() OVER (ORDER BY round(a{STEPS}.v, 12) DESC, url) AS rb FROM r{STEPS} JOIN a{STEPS} USING (url)),
n AS (SELECT greatest(ra, rb) AS k, count(*) AS n FROM o GROUP BY 1)
SELECT o.ra AS k, round(100.0::DOUBLE * sum(coalesce(n.n, 0)) OVER (ORDER BY o.ra) / o.ra, 6) AS overlap FROM o LEFT JOIN n ON n.k = o.ra""",
)
def rank_overlap(t):
    edges = materialize(supply_edges(t), "supply")
    g = graph.Packed(supply_nodes(edges), edges)
    a = graph.pagerank(g.nodes, edges, steps=STEPS, tol=None, packed=g)
    scored = materialize(a.join(graph.hits(g.nodes, edges, steps=STEPS, tol=None, packed=g), "url"), "scored")
    g.release()
    return graph.rank_overlap(scored, "pagerank", "authority")


@query("q_rank_overlap_converged")
def rank_overlap_converged(t):
    """q_rank_overlap of ranks iterated to convergence, ordered by twelve places of them."""
    edges = materialize(supply_edges(t), "supply")
    g = graph.Packed(supply_nodes(edges), edges)
    scored = materialize(graph.pagerank(g.nodes, edges, **END, packed=g).join(graph.hits(g.nodes, edges, packed=g), "url"), "scored")
    g.release()
    return graph.rank_overlap(scored, "pagerank", "authority")


# Crawls of the snapshot from all its pages

ONE_EACH = f"FROM (SELECT {at(_NORMAL)} AS url, arg_min(html, page_id) AS html FROM pages GROUP BY 1))"
FIRST = f"""{LINKS.replace("FROM pages)", ONE_EACH)}, {SEEDS}, fetched AS (SELECT {at(_NORMAL)} AS url, min(page_id) AS page_id FROM pages GROUP BY 1)"""


def ordered_seeds(t):
    return t("pages").select("url", F.col("page_id").alias("ord"))


def snapshot(t):
    """One page of each address."""
    p = t("pages").select(urls.normal_url(F.col("url")).alias("url"), "page_id", "html")
    return p.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))


QUOTA = f"""ranked AS (SELECT url, page_id, {at(_DOMAIN)} AS site, row_number() OVER (PARTITION BY {at(_DOMAIN)} ORDER BY page_id) AS k FROM fetched)"""


@query("q_crawl_quota", f"WITH {FIRST}, {QUOTA} SELECT site, count(*) AS attempts FROM ranked WHERE k <= 30 GROUP BY site")
def crawl_quota(t):
    """Attempts of each site at the first level, 30 at most."""
    visited, _, _ = graph.crawl(ordered_seeds(t), snapshot(t), max_logical=0)
    return visited.groupBy(urls.domain(F.col("url")).alias("site")).agg(F.count("*").alias("attempts"))


@query("q_crawl_bfs", f"WITH {FIRST} SELECT DISTINCT dst AS url FROM links WHERE dst NOT IN (SELECT url FROM seeds)")
def crawl_bfs(t):
    """Addresses that the second level finds new."""
    visited, _, _ = graph.crawl(ordered_seeds(t), snapshot(t), per_site=None, max_logical=1, max_physical=None)
    return visited.filter("logical = 1").select("url")


@query(
    "q_crawl_stats",
    f"""WITH {FIRST}, {QUOTA}, mine AS (SELECT l.*, {at(_DEPTH, 'l.dst')} AS depth, {at(_DOMAIN, 'l.dst')} AS dsite FROM links l JOIN (SELECT DISTINCT url FROM ranked WHERE k <= 30) r ON r.url = {at(_NORMAL, 'l.src')}),
used AS (SELECT site, count(*) AS used FROM ranked WHERE k <= 30 GROUP BY site),
fresh AS (SELECT dst, depth <= 3 AND coalesce(used, 0) < 30 AS ok FROM mine LEFT JOIN used ON used.site = mine.dsite WHERE dst NOT IN (SELECT url FROM seeds))
SELECT 0 AS level, (SELECT CAST(sum(used) AS BIGINT) FROM used) AS ok, 0 AS failed, (SELECT count(*) FROM mine) AS links, (SELECT count(DISTINCT dst) FROM fresh WHERE ok) AS queued, (SELECT count(*) FROM fresh WHERE NOT ok) AS filtered""",
)
def crawl_stats(t):
    """Counters of the first level."""
    _, _, counters = graph.crawl(ordered_seeds(t), snapshot(t), max_logical=1)
    return counters.filter("level = 0").select("level", "ok", "failed", "links", "queued", "filtered")


def visits(crawled):
    visited, edges, _ = crawled
    return visited.join(edges.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("links")), "url", "left").select("url", "ord", "logical", "fetched", F.coalesce("links", F.lit(0)).alias("links"))


@query("q_crawl_multi")
def crawl_multi(t):
    """All sites: 30 attempts each, levels 0 to 3, paths of up to three parts."""
    return visits(graph.crawl(ordered_seeds(t), snapshot(t)))


@query("q_crawl_domain")
def crawl_domain(t):
    """The domain of the first page: up to four levels and path parts; what was fetched."""
    return visits(graph.crawl(ordered_seeds(t), snapshot(t), per_site=None, max_logical=4, max_physical=4, one_domain=True)).filter("fetched").withColumn("kind", urls.kind(F.col("url")))


@query("q_crawl_ranked")
def crawl_ranked(t):
    """A crawl of one domain that stops after 500 successes, with PageRank and authority of its closed graph."""
    visited, edges, _ = graph.crawl(ordered_seeds(t), snapshot(t), per_site=None, max_logical=100, max_physical=None, one_domain=True, max_pages=500)
    got = materialize(visited.filter("fetched").select("url", "ord", urls.physical_depth(F.col("url")).cast("bigint").alias("depth")), "crawled")
    closed = materialize(graph.closed_graph(edges, got), "closed")
    return got.join(graph.pagerank(got, closed), "url").join(graph.hits(got, closed).select("url", "authority"), "url").select(
        "url", "ord", "depth", F.round("pagerank", 8).alias("pagerank"), F.round("authority", 8).alias("authority")
    )
