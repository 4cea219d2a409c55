"""Queries on hashes, spans, tokens and URLs."""

from pyspark.sql import functions as F

from siftline.functions import html, urls
from siftline.operators import extraction
from siftline.plans.extraction import NODE_SQL, STRIP_SQL, table


def content_hashes(spark, sf_dir):
    canon = html.canonical_html(F.col("html"))
    meta = F.concat(F.lit('\n---METADATA---\n{"url":"'), F.col("url"), F.lit('","contentType":"text/html"}'))
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.sha2("html", 256).alias("raw_sha256"),
        F.concat(F.lit("sha256:"), F.sha2(canon, 256)).alias("body_hash"),
        F.concat(F.lit("sha256:"), F.sha2(F.concat(canon, meta), 256)).alias("content_hash"),
    )
    return rows.withColumn("is_valid", F.col("content_hash").rlike("^sha256:[a-f0-9]{64}$"))


def duplicate_bodies(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.sha2(html.canonical_html(F.col("html")), 256).alias("body_hash"))
    return rows.groupBy("body_hash").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n_pages"))


def url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"))


def normal_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise(F.col("url")).alias("normal_url"))


def page_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls.links(F.col("html"), F.col("url"))).alias("link_no", "link"))
    keep = urls.passes(F.col("link"), urls.origin(F.col("link")), "/", ["/[a-m]", "/[A-Z]"], ["ing$"])
    return rows.withColumn("passes", keep)


def token_reduction(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        "page_id", html.estimate_tokens(F.col("html")).alias("raw"), html.estimate_tokens(html.strip_html(F.col("html"))).alias("text")
    )
    return rows.select("page_id", F.col("raw").alias("raw_tokens"), F.col("text").alias("text_tokens"), F.round(100 * (1 - F.col("text") / F.col("raw")), 4).alias("reduction_percent"))


def token_report(spark, sf_dir):
    rows = token_reduction(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("n_pages"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("text_tokens").alias("text_tokens"),
        F.round(F.avg("reduction_percent"), 4).alias("mean_percent"),
        F.round(100 * (1 - F.sum("text_tokens") / F.sum("raw_tokens")), 4).alias("overall_percent"),
    )


def source_spans(spark, sf_dir):
    """Where the text of each node stands in its page as it came; nodes with markup inside stand nowhere as one piece."""
    pages = table(spark, sf_dir, "pages")
    rows = extraction.nodes(pages).select("page_id", "node_no", "text").join(pages.select("page_id", "html"), "page_id")
    pos = F.instr("html", F.col("text")) - 1
    rows = rows.withColumn("start", F.when(pos < 0, 0).otherwise(pos)).withColumn("found", pos >= 0)
    rows = rows.withColumn("end", F.when(F.col("found"), F.col("start") + F.length("text")).otherwise(0))
    return rows.select("page_id", "node_no", "start", "end", "found")


def flag_rollout(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id").distinct()
    key = F.concat(F.lit("new-ranking:"), F.col("user_id").cast("string"))
    return rows.select("user_id", urls.rolling_hash(key).alias("hash"), urls.rollout(key, F.lit(25)).alias("enabled"))


def normal_titles(spark, sf_dir):
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", " "), r"\s+", " "))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("title"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hashes, duplicate_bodies, url_keys, normal_urls, page_links, token_reduction, token_report, source_spans,
        flag_rollout, normal_titles,
    )
}

_CANON = "html"
for _p, _r, _f in (
    (r"<!--[\s\S]*?-->", "", "g"), (r"<script\b[\s\S]*?</script>", " ", "gi"), (r"<style\b[\s\S]*?</style>", " ", "gi"),
    (r"\s+", " ", "g"), (r"\s*<", "<", "g"), (r">\s*", ">", "g"),
):
    _CANON = f"regexp_replace({_CANON}, '{_p}', '{_r}', '{_f}')"
_CANON = f"trim({_CANON})"


def _normal_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '#.*$', '')"
    base = f"regexp_extract({bare}, '^[^?]*')"
    host = rf"lower(regexp_extract({base}, '^(https?://[^/?#]+)', 1, 'i'))"
    path = rf"regexp_replace({base}, '^https?://[^/?#]+', '', 'i')"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '')), '&')"
    tail = f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
    whole = f"{host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {tail}"
    cut = f"CASE WHEN {path} NOT IN ('', '/') AND ({whole}) LIKE '%/' THEN regexp_replace({whole}, '/$', '') ELSE {whole} END"
    return f"CASE WHEN {host} = '' THEN '' ELSE {cut} END"


_RED = f"SELECT page_id, ceil(length(html) / 4)::BIGINT AS raw_tokens, ceil(length({STRIP_SQL}) / 4)::BIGINT AS text_tokens FROM pages"
ORACLE_SQL = {
    "content_hashes": f"""WITH c AS (SELECT page_id, html, url, {_CANON} AS canon FROM pages)
SELECT page_id, sha256(html) AS raw_sha256, 'sha256:' || sha256(canon) AS body_hash,
  'sha256:' || sha256(canon || chr(10) || '---METADATA---' || chr(10) || '{{"url":"' || url || '","contentType":"text/html"}}') AS content_hash,
  TRUE AS is_valid FROM c""",
    "duplicate_bodies": f"SELECT sha256({_CANON}) AS body_hash, min(page_id) AS first_page, count(*) AS n_pages FROM pages GROUP BY 1",
    "url_keys": "SELECT page_id, left(sha256(regexp_replace(lower(trim(url)), '/+$', '')), 16) AS url_key FROM pages",
    "normal_urls": f"SELECT page_id, {_normal_sql('url')} AS normal_url FROM pages",
    "page_links": rf"""WITH raw AS (
  SELECT page_id, url, unnest(l) AS x, unnest(range(len(l))) AS k
  FROM (SELECT page_id, url, list_transform(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1, 'i'),
    lambda x: trim(regexp_replace(x, '^["'']|["'']$', '', 'g'))) AS l FROM pages)
), abs AS (
  SELECT page_id, k, CASE WHEN regexp_matches(x, '^https?://', 'i') THEN x WHEN x LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1, 'i') || x
    WHEN x LIKE '/%' THEN o || x ELSE o || '/' || x END AS u
  FROM (SELECT *, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1, 'i')) AS o FROM raw)
  WHERE x NOT IN ('', '#') AND NOT regexp_matches(x, '^(javascript:|mailto:|tel:|data:)')
), n AS (SELECT page_id, {_normal_sql('u')} AS link, min(k) AS k FROM abs GROUP BY 1, 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS link_no, link,
  regexp_replace(link, '^https?://[^/?#]+', '') LIKE '/%' AND (regexp_matches(link, '/[a-m]') OR regexp_matches(link, '/[A-Z]')) AND NOT regexp_matches(link, 'ing$') AS passes
FROM n WHERE link <> ''""",
    "token_reduction": f"SELECT *, round(100 * (1 - text_tokens / raw_tokens), 4) AS reduction_percent FROM ({_RED})",
    "token_report": f"""SELECT count(*) AS n_pages, sum(raw_tokens)::BIGINT AS raw_tokens, sum(text_tokens)::BIGINT AS text_tokens,
  round(avg(round(100 * (1 - text_tokens / raw_tokens), 4)), 4) AS mean_percent, round(100 * (1 - sum(text_tokens) / sum(raw_tokens)), 4) AS overall_percent FROM ({_RED})""",
    "source_spans": f"""WITH {NODE_SQL}, s AS (SELECT page_id, node_no, text, instr(html, text) - 1 AS pos FROM node JOIN pages USING (page_id) WHERE length(text) > 0)
SELECT page_id, node_no, greatest(pos, 0)::INTEGER AS "start", (CASE WHEN pos >= 0 THEN pos + length(text) ELSE 0 END)::INTEGER AS "end", pos >= 0 AS found FROM s""",
    "flag_rollout": """WITH u AS (SELECT DISTINCT user_id FROM events),
h AS (SELECT user_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split('new-ranking:' || user_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS w FROM u),
s AS (SELECT user_id, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS hash FROM h)
SELECT user_id, hash, abs(hash) % 100 < 25 AS enabled FROM s""",
    "normal_titles": r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part",
}
