"""Queries on what is written and read back: listing files, snapshots, checkpoints, a vector store, reports; and exports
of listings, prices and conditions by shop."""

from pyspark.sql import functions as F

from siftline.operators import listings, operations, sinks
from siftline.plans.extraction import table
from siftline.plans.streams import _folder
from siftline.sources import exports


def _k():
    return F.col("p_partkey")


def listing_files(spark, sf_dir):
    """Lines of a listing file with all its columns, as CSV."""
    k = _k()
    rows = sinks.listing_rows(
        table(spark, sf_dir, "part"), id=F.concat(F.lit("p"), k), marketplace=F.lit("ebay"), title=F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')),
        price_amount=F.format_string("%.2f", "p_retailprice"), price_currency=F.lit("USD"), condition=F.when(k % 2 == 0, "new"), availability=F.lit("in_stock"),
        images=F.array_join(F.array(F.concat(F.lit("a"), k), F.lit("b")), "|"), item_number=k.cast("string"), category=F.array_join(F.array("p_type", "p_brand"), "|"), confidence=F.lit("0.9"),
    )
    return sinks.csv_lines(rows, *sinks.LISTING_COLUMNS)


def appended_listings(spark, sf_dir):
    """Listings appended to a file of JSON lines in two goes, a folder for each brand, and read again."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.when(_k() % 3 > 0, F.col("p_retailprice")).alias("price"))
    sinks.append_json(rows.filter("p_partkey % 2 = 0"), path, "p_brand")
    sinks.append_json(rows.filter("p_partkey % 2 = 1"), path, "p_brand")
    return spark.read.schema("p_partkey long, p_name string, price double, p_brand string").json(path)


def stored_snapshots(spark, sf_dir):
    """Two versions of each page are kept; the newest is read."""
    path = _folder(spark)
    pages = table(spark, sf_dir, "pages").select("url", "html", F.timestamp_seconds("page_id").alias("ts"))
    sinks.save_snapshots(pages, path, "url", "html", "ts")
    sinks.save_snapshots(pages.withColumns({"html": F.concat("html", F.lit("<!-- 2 -->")), "ts": F.timestamp_seconds(F.unix_seconds("ts") + 10_000_000)}), path, "url", "html", "ts")
    return sinks.latest_snapshots(spark, path).select("url_key", "content_hash", F.unix_seconds("ts").alias("at"), "versions")


def saved_checkpoints(spark, sf_dir):
    """Progress of jobs: one for each part, with another checkpoint for every fifth; the later one takes the counts over."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("processed"), F.count_if(F.col("l_quantity") > 25).alias("failed"))
    later = rows.filter("l_partkey % 5 = 0").withColumns({"processed": F.col("processed") + 10, "failed": F.col("failed") * 2})
    return sinks.upsert(rows, later, ["l_partkey"], ["processed", "failed"])


def vector_store(spark, sf_dir):
    """A store of entries: added, some overwritten by id, one label cleared; what it holds in the end."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    again = rows.filter("vec_id % 10 = 0").withColumn("version", F.lit(2))
    new = again.withColumn("vec_id", -F.col("vec_id") - 1)
    held = sinks.upsert(rows, again.union(new), ["vec_id"], ["label", "version"]).filter("label <> 3")
    return held.groupBy("label", "version").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def listing_exports(spark, sf_dir):
    """An export of listings, some without an address, a price or a quantity."""
    k = _k()
    raw = table(spark, sf_dir, "part").select(
        k.cast("string").alias("Item Number"), F.concat(F.lit(" "), "p_name").alias("Title"), F.when(k % 4 > 0, F.concat(F.lit("£"), F.format_number("p_retailprice", 2))).alias("Current Price"),
        F.when(k % 8 > 0, F.lit("$1")).alias("Start Price"), F.when(k % 3 == 0, F.col("p_size").cast("string")).otherwise("x").alias("Available Quantity"), F.lit("5-Mar-24").alias("Start Date"),
        F.col("p_type").alias("Category"), F.when(k % 2 == 0, F.lit("https://x.example/1")).otherwise("").alias("View Item URL"),
    )
    kind, rows = exports.read_export(raw)
    return rows.select(
        "item_id", "title", "price", "currency", "quantity", F.col("listed_on").cast("string").alias("listed_on"), "category", "url", F.array_join("errors", ";").alias("errors"), F.lit(kind).alias("kind")
    )


def shop_prices(spark, sf_dir):
    """Prices and conditions as each shop's adapter reads the same texts."""
    k = _k()
    text = F.concat(F.element_at(F.array(*map(F.lit, ("$", "£", "€", "CAD ", "USD ", ""))), (k % 6 + 1).cast("int")), F.format_number("p_retailprice", 2))
    cond = F.element_at(F.array(*map(F.lit, ("Used - Like New", "Used - Very Good", "Pre-Owned", "Refurbished", "for parts", ""))), (k % 6 + 1).cast("int"))
    out = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"), cond.alias("c"))
    prices = {s: listings.price_of(F.col("t"), s) for s in listings.PRICE_RULES}
    return out.select(
        "p_partkey", *[p["currency"].alias(f"currency_{s}") for s, p in prices.items()], listings.money(prices["ebay"]["amount"], prices["ebay"]["currency"]).alias("written"),
        *[listings.condition_of(F.col("c"), s).alias(f"condition_{s}") for s in listings.CONDITION_RULES],
    )


def telemetry_report(spark, sf_dir):
    """A report's sections as lines: counts by type and health."""
    events = table(spark, sf_dir, "events")
    rolled = operations.telemetry(events, "event_type", F.col("value") >= 10, "value")
    return sinks.report({"counts": events.groupBy("event_type").agg(F.count("*").alias("n")), "health": operations.health(rolled).select("event_type", "state")})


QUERIES = {
    f.__name__: f
    for f in (
        listing_files, appended_listings, stored_snapshots, saved_checkpoints, vector_store, listing_exports, shop_prices, telemetry_report,
    )
}

_FIELDS = {
    "id": "'p' || p_partkey", "marketplace": "'ebay'", "title": "chr(34) || p_name || ', ' || repeat(chr(34), 2) || p_brand || repeat(chr(34), 3)", "price_amount": "printf('%.2f', p_retailprice)", "price_currency": "'USD'",
    "condition": "CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE '' END", "availability": "'in_stock'", "images": "'a' || p_partkey || '|b'", "item_number": "p_partkey::VARCHAR",
    "category": "p_type || '|' || p_brand", "confidence": "'0.9'",
}
ORACLE_SQL = {
    "listing_files": "SELECT " + " || ',' || ".join(_FIELDS.get(c, "''") for c in sinks.LISTING_COLUMNS) + " AS line FROM part",
    "appended_listings": "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS price, p_brand FROM part",
    "stored_snapshots": """WITH p AS (SELECT left(sha256(regexp_replace(lower(trim(url)), '/+$', '')), 16) AS url_key, page_id, html FROM pages)
SELECT url_key, sha256(arg_max(html, page_id) || '<!-- 2 -->') AS content_hash, (max(page_id) + 10000000)::BIGINT AS "at", 2 * count(*) AS versions FROM p GROUP BY 1""",
    "saved_checkpoints": """SELECT l_partkey, count(*) + CASE WHEN l_partkey % 5 = 0 THEN 10 ELSE 0 END AS processed, count(*) FILTER (l_quantity > 25) * CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 1 END AS failed
FROM lineitem GROUP BY l_partkey""",
    "vector_store": """WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END AS version FROM embeddings UNION ALL SELECT -vec_id - 1, label, 2 FROM embeddings WHERE vec_id % 10 = 0)
SELECT label, version::INTEGER AS version, count(*) AS n, min(vec_id) AS first FROM e WHERE label <> 3 GROUP BY 1, 2""",
    "listing_exports": """SELECT p_partkey::VARCHAR AS item_id, p_name AS title, CASE WHEN p_partkey % 4 > 0 THEN round(p_retailprice, 2) WHEN p_partkey % 8 > 0 THEN 1.0 END::DOUBLE AS price,
  CASE WHEN p_partkey % 4 > 0 THEN 'GBP' WHEN p_partkey % 8 > 0 THEN 'USD' END AS currency, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 1 END::INTEGER AS quantity, '2024-03-05' AS listed_on, p_type AS category,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://x.example/1' ELSE 'https://www.ebay.com/itm/' || p_partkey END AS url, CASE WHEN p_partkey % 8 = 0 THEN 'missing price' ELSE '' END AS errors, 'listings' AS kind FROM part""",
    "shop_prices": """WITH x AS (SELECT *, p_partkey % 6 AS i FROM part)
SELECT p_partkey, ['USD', 'GBP', 'EUR', 'USD', 'USD', 'USD'][i + 1] AS currency_ebay, ['USD', 'GBP', 'EUR', 'CAD', 'USD', 'USD'][i + 1] AS currency_amazon, 'USD' AS currency_walmart,
  ['$', '£', '€', '$', '$', '$'][i + 1] || printf('%.2f', p_retailprice) AS written, ['new', 'used_very_good', 'new', 'refurbished', 'new', 'new'][i + 1] AS condition_amazon,
  ['new', 'used_good', 'used_good', 'refurbished', 'new', 'new'][i + 1] AS condition_walmart, ['new', 'used', 'unknown', 'refurbished', 'parts', 'unknown'][i + 1] AS condition_analysis FROM x""",
    "telemetry_report": """WITH r AS (SELECT event_type, count(*) AS n, (count(*) FILTER (value >= 10)) / count(*) AS s, sum(value) / count(*) AS d FROM events GROUP BY 1)
SELECT 'counts' AS section, '{"event_type":"' || event_type || '","n":' || n || '}' AS line FROM r
UNION ALL SELECT 'health', '{"event_type":"' || event_type || '","state":"' || CASE WHEN s < 0.5 THEN 'unhealthy' WHEN s < 0.8 OR d > 150 THEN 'degraded' ELSE 'healthy' END || '"}' FROM r""",
}
