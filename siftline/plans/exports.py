"""Queries on what is read: order exports, robots files, sitemaps, tables in pages and merged fetches. Their inputs are
written from the tables as lines of text, read back by the readers' parsers, and held against the tables."""

from pyspark.sql import functions as F

from siftline.functions import running, urls
from siftline.operators import structured
from siftline.operators.extraction import observations
from siftline.plans.extraction import PIECES_SQL, _texts_sql, dealt, decoded_sql, table
from siftline.sources import exports

AGENT = "sift"


def order_exports(spark, sf_dir):
    """Two exports of other headers, each one's dates and prices spelt its own way, as one table."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    price = F.format_number("o_totalprice", 2)
    amazon = rows.filter(k % 2 == 0).select(
        k.cast("string").alias("Order ID"), F.date_format("o_orderdate", "M/d/yyyy").alias("Order Date"), F.concat(F.lit(" Item "), k, F.lit(" ")).alias("Item Name"),
        F.concat(F.lit("$"), price).alias("Item Price"), F.when(k % 3 == 0, "2").otherwise("").alias("Quantity"), F.lit("A shop").alias("Seller"),
    )
    ebay = rows.filter(k % 2 == 1).select(
        k.cast("string").alias("Order Number"), F.date_format("o_orderdate", "d-MMM-yyyy").alias("Sale Date"), F.when(k % 5 > 0, F.concat(F.lit("Item "), k)).alias("Item Title"),
        F.concat(F.lit("£"), price).alias("Sale Price"), F.lit("1").alias("Quantity"), F.lit("b").alias("Buyer Username"),
    )
    out = exports.orders(amazon).unionByName(exports.orders(ebay))
    return out.select("order_id", F.col("ordered_on").cast("string").alias("ordered_on"), "title", "price", "currency", "quantity", "seller", F.array_join("errors", ";").alias("errors"))


def crawlable_urls(spark, sf_dir):
    """What the robots file of each host lets our agent fetch. Hosts that begin with m. name our agent; others have only
    rules for all."""
    path = F.regexp_replace("url", "^(?i)https?://[^/?#]+", "")
    pages = table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), path.alias("path"))
    text = F.when(F.col("origin").contains("://m."), "User-agent: Sift\nDisallow: /a  # some\nAllow: /ab\n\nUser-agent: *\nDisallow: /").otherwise(
        "# all\nUser-agent: *\nDisallow: /b\nAllow: /be\nDisallow: /c"
    )
    rules = exports.robots_rules(pages.select("origin").distinct().select("origin", text.alias("text")), "origin", "text")
    return exports.allowed(pages, rules, AGENT).select("page_id", "allowed")


def sitemap_pages(spark, sf_dir):
    """The pages of each host's sitemaps: an index, and the maps it names."""
    pages = table(spark, sf_dir, "pages").select(urls.origin(F.col("url")).alias("origin"), F.col("page_id"), "url")
    maps = pages.groupBy("origin", (F.col("page_id") % 3).alias("part")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>\n")))).alias("x"))
    maps = maps.select(F.concat("origin", F.lit("/map"), "part", F.lit(".xml")).alias("at"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("xml"))
    index = pages.groupBy("origin").agg(
        F.concat(F.lit("<sitemapindex>"), F.concat_ws("", F.collect_set(F.concat(F.lit("<sitemap><loc>"), "origin", F.lit("/map"), F.col("page_id") % 3, F.lit(".xml</loc></sitemap>")))), F.lit("</sitemapindex>")).alias("xml")
    )
    every = maps.unionByName(index.select(F.concat("origin", F.lit("/sitemap.xml")).alias("at"), "xml"))
    return exports.sitemap(every, "at", "xml", "/sitemap.xml").groupBy("url").agg(F.count("*").alias("n"))


def merged_fetches(spark, sf_dir):
    """Pages fetched again: unchanged ones (304) keep the body they had, others bring a new one."""
    k = F.col("page_id")
    old = table(spark, sf_dir, "pages").filter(k % 5 > 0).select("url", F.col("html").alias("body"), F.concat(F.lit('"'), k, F.lit('"')).alias("etag"), k.alias("etag_no"))
    first = old.groupBy("url").agg(F.min_by(F.struct("body", "etag"), "etag_no").alias("x")).select("url", "x.*")
    status = F.when((k % 5 > 0) & (k % 3 == 0), 304).otherwise(200)
    new = table(spark, sf_dir, "pages").select("page_id", "url", status.alias("status"), F.when(status == 200, F.lower("html")).alias("body"))
    out = exports.merge_fetches(new, first)
    return out.groupBy("page_id", "status", "from_cache").agg(F.max(F.sha2("body", 256)).alias("body_hash"))


def table_cells(spark, sf_dir):
    """Cells of tables in pages, one table for each brand with its parts in rows."""
    row = F.concat(F.lit("<tr><td>"), "p_partkey", F.lit("</td><td> "), "p_name", F.lit("</td><td>"), F.format_number("p_retailprice", 2), F.lit("</td></tr>"))
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("x"))))
    parts = running.totals(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice"), ["p_brand"], ["p_partkey"], no=F.lit(1))
    parts = parts.withColumn("_block", F.floor(F.col("no") / 400))
    pages = dealt(parts, "p_brand", "_block").groupBy("p_brand", "_block").agg(rows.alias("r"))
    page = F.concat(F.lit("<html><table class=x><tr><th>Key</th><th>Name</th><th>Price</th></tr>"), F.array_join(F.transform("r", lambda r: r["x"]), "\n"), F.lit("</table></html>"))
    out = structured.tables(pages.select(F.concat_ws("/", "p_brand", "_block").alias("page_id"), page.alias("html")))
    return out.select(F.col("values")["Key"].alias("key"), F.col("values")["Name"].alias("name"), F.col("values")["Price"].alias("price"))


def page_observations(spark, sf_dir):
    """What an agent is told of a page: its first twenty navigation links, first ten headings, and counts."""
    return observations(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f for f in (order_exports, crawlable_urls, sitemap_pages, merged_fetches, table_cells, page_observations)
}
ORACLE_SQL = {
    "order_exports": """SELECT o_orderkey::VARCHAR AS order_id, o_orderdate::DATE::VARCHAR AS ordered_on, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 > 0 THEN 'Item ' || o_orderkey END AS title,
  round(o_totalprice, 2) AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'GBP' END AS currency, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END::INTEGER AS quantity,
  CASE WHEN o_orderkey % 2 = 0 THEN 'A shop' ELSE 'b' END AS seller, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN 'missing title' ELSE '' END AS errors FROM orders""",
    "crawlable_urls": """WITH p AS (SELECT page_id, contains(url, '://m.') AS m, regexp_replace(url, '^https?://[^/?#]+', '', 'i') AS path FROM pages)
SELECT page_id, CASE WHEN m THEN NOT starts_with(path, '/a') OR starts_with(path, '/ab') ELSE NOT (starts_with(path, '/b') AND NOT starts_with(path, '/be') OR starts_with(path, '/c')) END AS allowed FROM p""",
    "sitemap_pages": "SELECT url, count(*) AS n FROM pages GROUP BY 1",
    "merged_fetches": """WITH o AS (SELECT url, html FROM pages WHERE page_id % 5 > 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT page_id, CASE WHEN c THEN 304 ELSE 200 END::INTEGER AS status, c AS from_cache, sha256(CASE WHEN c THEN o.html ELSE lower(p.html) END) AS body_hash
FROM (SELECT *, page_id % 5 > 0 AND page_id % 3 = 0 AS c FROM pages) p LEFT JOIN o USING (url)""",
    "table_cells": "SELECT p_partkey::VARCHAR AS key, p_name AS name, format('{:,.2f}', p_retailprice) AS price FROM part",
    "page_observations": r"""WITH x AS (SELECT page_id, html, regexp_extract(html, '<nav(?:\s[^>]*)?>([\s\S]*?)</nav>', 1, 'i') AS nav FROM pages)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(nav, '<(?:a)(?:\s[^>]*)?>([^<]*)', 1, 'i'), lambda x: """
    + decoded_sql("x")
    + r""")[1:20], '|') AS links, array_to_string("""
    + _texts_sql("h[1-6]", 1).format(PIECES_SQL)
    + r"""[1:10], '|') AS headings,
  len(regexp_extract_all(html, '<a\s', 0, 'i'))::INTEGER AS n_links, len(regexp_extract_all(html, '<(?:input|select|textarea)\b', 0, 'i'))::INTEGER AS n_inputs,
  len(regexp_extract_all(html, '<img\b', 0, 'i'))::INTEGER AS n_images FROM x""",
}
