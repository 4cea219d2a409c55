"""Queries on versions and links. Documents of one source, in order of their ids, serve as versions."""

from pyspark.sql import functions as F

from siftline.functions import html, urls
from siftline.operators import changes, crawls
from siftline.plans.extraction import STRIP_SQL, table

DEPTH, PAGES = 4, 60


def change_history(spark, sf_dir):
    return changes.history(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def change_counts(spark, sf_dir):
    rows = changes.history(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return rows.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("first", "same", "changed")])


def pruned_versions(spark, sf_dir):
    return changes.prune(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", 5)


def latest_versions(spark, sf_dir):
    return changes.latest(table(spark, sf_dir, "documents"), "source", "doc_id", "lang", "n_chars")


def version_diffs(spark, sf_dir):
    return changes.diffs(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def _edges(spark, sf_dir):
    """Two derived links of each page, as the pages' own links lead nowhere in the table."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.agg((F.max("page_id") + 1).alias("n"))
    rows = pages.crossJoin(F.broadcast(n))
    to = F.array(F.expr("(page_id * 3 + 1) % n"), F.expr("(page_id * 7 + 2) % n"))
    return rows.select(F.col("page_id").alias("src"), F.explode(to).alias("dst"))


def crawl_depths(spark, sf_dir):
    return changes.crawl(_edges(spark, sf_dir), [0], DEPTH)


def crawl_order(spark, sf_dir):
    """The first pages of a crawl from two starts, in breadth and in depth."""
    k, n = F.col("page_id"), table(spark, sf_dir, "pages").agg(F.max("page_id")).first()[0] + 1
    to = F.array((k * 3 + 1) % n, (k * 7 + 2) % n, (k * 3 + 1) % n, (k * 5 + 4) % n)
    edges = table(spark, sf_dir, "pages").select(k.alias("src"), F.posexplode(to).alias("pos", "dst"))
    both = [crawls.crawl_order(edges, [5, 0], DEPTH, PAGES, s).withColumn("strategy", F.lit(s)) for s in ("bfs", "dfs")]
    return both[0].union(both[1])


def crawl_statistics(spark, sf_dir):
    gated = html.first_reason(F.col("html"), html.CHALLENGES).isNotNull()
    rows = table(spark, sf_dir, "pages").select(
        F.when(gated, "blocked").otherwise("ok").alias("status"),
        html.estimate_tokens(F.col("html")).alias("raw"),
        html.estimate_tokens(html.strip_html(F.col("html"))).alias("text"),
        urls.origin(F.col("url")).alias("host"),
    )
    return changes.crawl_statistics(rows, "status", "raw", "text", "host")


def link_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(urls.links(F.col("html"), F.col("url"))).alias("link"))
    return rows.groupBy("link").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


QUERIES = {
    f.__name__: f
    for f in (change_history, change_counts, pruned_versions, latest_versions, version_diffs, crawl_depths, crawl_order, crawl_statistics, link_targets)
}
_HIST = """WITH h AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents),
p AS (SELECT *, lag(content_hash) OVER (PARTITION BY source ORDER BY doc_id) AS previous_hash FROM h),
k AS (SELECT *, CASE WHEN previous_hash IS NULL THEN 'first' WHEN previous_hash = content_hash THEN 'same' ELSE 'changed' END AS kind FROM p)"""
_WALLS = " OR ".join(f"regexp_matches(left(html, 4096), '{p}', 'i')" for p, _ in html.CHALLENGES)
from siftline.plans.provenance import ORACLE_SQL as _PROVENANCE  # noqa: E402

ORACLE_SQL = {
    "change_history": f"{_HIST} SELECT * FROM k",
    "change_counts": f"{_HIST} SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in ("first", "same", "changed")) + " FROM k GROUP BY 1",
    "pruned_versions": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5",
    "latest_versions": "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1",
    "crawl_depths": f"""WITH RECURSIVE e AS (SELECT page_id AS src, unnest([(page_id * 3 + 1) % n, (page_id * 7 + 2) % n]) AS dst FROM pages, (SELECT max(page_id) + 1 AS n FROM pages)),
r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {DEPTH})
SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1""",
    "crawl_order": f"""WITH RECURSIVE e AS (SELECT page_id AS src, [(page_id * 3 + 1) % n, (page_id * 7 + 2) % n, (page_id * 5 + 4) % n] AS l FROM pages, (SELECT max(page_id) + 1 AS n FROM pages)),
w AS (
  SELECT s.strategy, CASE WHEN s.strategy = 'bfs' THEN [struct_pack(node := 5::BIGINT, depth := 0, parent := NULL::BIGINT), struct_pack(node := 0::BIGINT, depth := 0, parent := NULL::BIGINT)]
    ELSE [struct_pack(node := 0::BIGINT, depth := 0, parent := NULL::BIGINT), struct_pack(node := 5::BIGINT, depth := 0, parent := NULL::BIGINT)] END AS q,
    [5::BIGINT, 0::BIGINT] AS seen, -1::BIGINT AS place, NULL::STRUCT(node BIGINT, depth INTEGER, parent BIGINT) AS here FROM (VALUES ('bfs'), ('dfs')) s(strategy)
  UNION ALL
  SELECT strategy, list_concat(rest, list_transform(new, lambda x: struct_pack(node := x, depth := x0.depth + 1, parent := x0.node))), list_concat(seen, new), place + 1, x0
  FROM (SELECT w.strategy, w.seen, w.place, x0, rest, CASE WHEN x0.depth < {DEPTH} THEN list_filter([e.l[1], e.l[2], e.l[3]], lambda x, i: NOT list_contains(w.seen, x) AND list_position(e.l, x) = i) ELSE [] END AS new
    FROM (SELECT *, CASE WHEN strategy = 'bfs' THEN q[1] ELSE q[-1] END AS x0, CASE WHEN strategy = 'bfs' THEN q[2:] ELSE q[:-2] END AS rest FROM w WHERE len(q) > 0 AND place + 1 < {PAGES}) w
    JOIN e ON e.src = x0.node)
) SELECT strategy, here.node AS node, place, here.depth AS depth, here.parent AS parent FROM w WHERE here IS NOT NULL""",
    "crawl_statistics": f"""WITH p AS (SELECT {_WALLS} AS b, ceil(length(html) / 4)::BIGINT AS raw, ceil(length({STRIP_SQL}) / 4)::BIGINT AS t, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1, 'i')) AS h FROM pages)
SELECT count(*) AS n_pages, count(*) FILTER (NOT b) AS n_ok, count(*) FILTER (b) AS n_blocked, sum(raw)::BIGINT AS tokens_in, sum(t)::BIGINT AS tokens_out,
  floor((1 - sum(t) / sum(raw)) * 100 + 0.5)::BIGINT AS savings_percent, count(DISTINCT h) AS n_hosts FROM p""",
    "link_targets": f"SELECT link, count(*) AS n_pages, min(page_id) AS first_page FROM ({_PROVENANCE['page_links']}) GROUP BY 1",
}
