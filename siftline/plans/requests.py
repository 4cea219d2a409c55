"""Queries on requests: addresses that may be fetched, cache keys, kinds of content, search URLs, templates."""

from pyspark.sql import functions as F

from siftline.functions import requests as rq
from siftline.plans.extraction import table

BLOCKED, ALLOWED = ["m.example.com"], ["10.0.0.7"]
TEMPLATE = "user {{user}} did {{what}} at {{where}}"


def _urls(spark, sf_dir):
    """URLs of pages, and some of all kinds of address from the numbers of events."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), "page_id").alias("id"), "url")
    e, u = F.col("event_id"), F.col("user_id")
    first = F.element_at(F.array(*map(F.lit, (0, 10, 100, 127, 169, 172, 192, 8))), (e % 8 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, (0, 16, 31, 32, 168, 254, 7))), (e % 7 + 1).cast("int"))
    v4 = F.concat_ws(".", first, second, u % 256, e % 300)
    v6 = F.element_at(F.array(*map(F.lit, ("::1", "fc00::1", "fdab::2", "fe80::3", "febf::4", "2001:db8::5", "::"))), (e % 7 + 1).cast("int"))
    url = (
        F.when(e % 11 < 5, F.concat(F.lit("http://"), v4, F.lit("/x")))
        .when(e % 11 == 5, F.concat(F.lit("https://["), v6, F.lit("]:8080/")))
        .when(e % 11 == 6, F.concat(F.lit("http://[::ffff:"), v4, F.lit("]")))
        .when(e % 11 == 7, F.concat(F.lit("ftp://host/"), u))
        .when(e % 11 == 8, F.lit("http://LOCALHOST:99"))
        .when(e % 11 == 9, F.concat(F.lit("no url "), e))
        .otherwise(F.lit("http://user:pw@10.0.0.7/ok"))
    )
    return pages.union(table(spark, sf_dir, "events").select(F.concat(F.lit("event "), e).alias("id"), url.alias("url")))


def url_checks(spark, sf_dir):
    rows = _urls(spark, sf_dir)
    return rows.select("id", "url", rq.blocked(F.col("url"), BLOCKED, ALLOWED).alias("blocked"))


def request_keys(spark, sf_dir):
    kind = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))
    params = F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", rq.cache_key(kind, params).alias("cache_key"))


def content_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.col("source").alias("origin"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page"), "page_id", "html", "url")
    rows = docs.union(pages)
    return rows.select("kind", "id", rq.content_kind(F.col("text")).alias("content_kind"), rq.marketplace(F.col("text"), F.col("origin")).alias("marketplace"))


def _searches(spark, sf_dir):
    k = F.col("p_partkey")
    url = rq.search_url(
        "https://shop.example/sch",
        F.concat_ws(" & ", "p_name", "p_brand"),
        sold=("LH_Sold", F.when(k % 2 == 0, 1)),
        low=("_udlo", F.when(k % 3 == 0, F.floor("p_retailprice").cast("long"))),
        high=("_udhi", F.when(k % 5 == 0, F.ceil(F.col("p_retailprice") * 2).cast("long"))),
        page=("_pgn", F.when(k % 7 == 0, k % 7 + 2)),
    )
    return table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))


def search_urls(spark, sf_dir):
    return _searches(spark, sf_dir)


def search_terms(spark, sf_dir):
    return _searches(spark, sf_dir).select("p_partkey", *[F.coalesce(v, F.lit(False)).alias(n) if n == "sold" else v.alias(n) for n, v in rq.search_terms(F.col("url")).items()])


def filled_templates(spark, sf_dir):
    text = rq.interpolate(F.lit(TEMPLATE), {"user": F.col("user_id"), "what": F.when(F.col("event_type") != "view", F.col("event_type"))})
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


def audit_rows(spark, sf_dir):
    """One line for each request: who (all but the first two digits masked), what, how it ended, how long it took."""
    user = F.col("user_id").cast("string")
    masked = F.concat(F.substring(user, 1, 2), F.lit("***"))
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    level = F.when(status >= 500, "error").otherwise("info")
    return table(spark, sf_dir, "events").select(
        "event_id", masked.alias("tenant"), F.concat(F.lit("/v1/"), "event_type").alias("path"), status.alias("status"),
        level.alias("level"), F.round("value", 3).alias("duration"),
    )


QUERIES = {f.__name__: f for f in (url_checks, request_keys, content_kinds, search_urls, search_terms, filled_templates, audit_rows)}

_V4 = r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_PRIVATE4 = """(a IN (0, 127, 10) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254))"""
_SEARCH = """s AS (SELECT p_partkey, 'https://shop.example/sch?_nkw=' || replace(url_encode(p_name || ' & ' || p_brand), '%20', '+')
  || CASE WHEN p_partkey % 2 = 0 THEN '&LH_Sold=1' ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN '&_udlo=' || floor(p_retailprice)::BIGINT ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN '&_udhi=' || ceil(p_retailprice * 2)::BIGINT ELSE '' END
  || CASE WHEN p_partkey % 7 = 0 THEN '&_pgn=' || (p_partkey % 7 + 2) ELSE '' END AS url FROM part)"""
ORACLE_SQL = {
    "url_checks": f"""WITH u AS (
  SELECT 'page ' || page_id AS id, url FROM pages
  UNION ALL SELECT 'event ' || event_id, CASE WHEN e < 5 THEN 'http://' || v4 || '/x' WHEN e = 5 THEN 'https://[' || v6 || ']:8080/' WHEN e = 6 THEN 'http://[::ffff:' || v4 || ']'
    WHEN e = 7 THEN 'ftp://host/' || user_id WHEN e = 8 THEN 'http://LOCALHOST:99' WHEN e = 9 THEN 'no url ' || event_id ELSE 'http://user:pw@10.0.0.7/ok' END
  FROM (SELECT *, event_id % 11 AS e, [0, 10, 100, 127, 169, 172, 192, 8][event_id % 8 + 1] || '.' || [0, 16, 31, 32, 168, 254, 7][event_id % 7 + 1] || '.' || (user_id % 256) || '.' || (event_id % 300) AS v4,
    ['::1', 'fc00::1', 'fdab::2', 'fe80::3', 'febf::4', '2001:db8::5', '::'][event_id % 7 + 1] AS v6 FROM events)
), h AS (
  SELECT *, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme,
    lower(regexp_replace(regexp_replace(split_part(regexp_replace(url, '^[a-zA-Z]+://', ''), '/', 1), '^.*@', ''), ':[0-9]+$', '')) AS host FROM u
), i AS (
  SELECT *, replace(replace(replace(host, '[', ''), ']', ''), '::ffff:', '') AS bare FROM h
), j AS (
  SELECT *, CASE WHEN regexp_matches(bare, '{_V4}') THEN split_part(bare, '.', 1)::INTEGER END AS a, CASE WHEN regexp_matches(bare, '{_V4}') THEN split_part(bare, '.', 2)::INTEGER END AS b FROM i
)
SELECT id, url, CASE WHEN scheme = '' THEN 'invalid' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '{BLOCKED[0]}' THEN 'host' WHEN host = '{ALLOWED[0]}' THEN NULL
  WHEN host = 'localhost' THEN 'localhost' WHEN a IS NOT NULL THEN CASE WHEN {_PRIVATE4} THEN 'private' END
  WHEN contains(host, '::ffff:') THEN 'invalid'
  WHEN contains(bare, ':') THEN CASE WHEN bare = '::1' OR regexp_matches(bare, '^f[cd]|^fe[89ab]') THEN 'private' END ELSE 'resolve' END AS blocked FROM j""",
    "request_keys": """SELECT event_id, 'query:' || left(sha256(event_type || CASE WHEN event_id % 3 > 0 THEN '{"kind":"' || event_type || '","user":"' || user_id || '"}' ELSE '' END), 16) AS cache_key FROM events""",
    "content_kinds": r"""WITH x AS (SELECT 'document' AS kind, doc_id AS id, text, source AS origin FROM documents UNION ALL SELECT 'page', page_id, html, url FROM pages),
y AS (SELECT *, lower(coalesce(text, '') || coalesce(origin, '')) AS both_ FROM x)
SELECT kind, id, CASE WHEN contains(text, '<html') OR contains(text, '<!DOCTYPE') THEN 'html' WHEN contains(text, 'From:') AND contains(text, 'Subject:') AND contains(text, 'order') THEN 'email'
  WHEN contains(text, '%PDF') OR contains(text, 'Invoice') OR contains(text, 'Receipt') THEN 'pdf_text' WHEN regexp_matches(text, '[ \t\n\x0b\f\r]{3,}|[A-Z]{10,}') THEN 'ocr_text' ELSE 'unknown' END AS content_kind,
  CASE WHEN contains(both_, 'ebay') THEN 'ebay' WHEN contains(both_, 'amazon') THEN 'amazon' WHEN contains(both_, 'walmart') THEN 'walmart' WHEN contains(both_, 'etsy') THEN 'etsy' END AS marketplace FROM y""",
    "search_urls": f"WITH {_SEARCH} SELECT * FROM s",
    "search_terms": """SELECT p_partkey, p_name || ' & ' || p_brand AS query, p_partkey % 2 = 0 AS sold, CASE WHEN p_partkey % 3 = 0 THEN floor(p_retailprice)::DOUBLE END AS min_price,
  CASE WHEN p_partkey % 5 = 0 THEN ceil(p_retailprice * 2)::DOUBLE END AS max_price, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 7 + 2 ELSE 1 END::INTEGER AS page FROM part""",
    "filled_templates": "SELECT event_id, 'user ' || user_id || ' did ' || CASE WHEN event_type <> 'view' THEN event_type ELSE '' END || ' at ' AS text FROM events",
    "audit_rows": """SELECT event_id, left(user_id::VARCHAR, 2) || '***' AS tenant, '/v1/' || event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END::INTEGER AS status,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, round(value, 3) AS duration FROM events""",
}
