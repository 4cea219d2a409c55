"""Queries on containers, metadata, tables, policies and what sinks write."""

from pyspark.sql import functions as F

from siftline.functions import html
from siftline.operators import operations, sinks, structured
from siftline.plans.extraction import decoded_sql, table

# Policies in load order with the host patterns they are for.
POLICIES = [("news", "www.*|news.*|*.news"), ("blogs", "blog.*"), ("mobile", "m.*")]


def container_scores(spark, sf_dir):
    rows = structured.score_containers(structured.containers(table(spark, sf_dir, "pages")))
    return rows.drop("element", "last").withColumn("score", F.round("score", 6))


def chosen_containers(spark, sf_dir):
    rows = structured.chosen_containers(structured.score_containers(structured.containers(table(spark, sf_dir, "pages"))))
    return rows.select("page_id", "tag", "no", "place", F.round("score", 6).alias("score"))


def page_metadata(spark, sf_dir):
    rows = structured.metadata(table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.size("json_ld").alias("n_json_ld"), F.size("open_graph").alias("n_open_graph"), "confidence")


def page_policies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", structured.policy(F.col("url"), POLICIES, "default").alias("policy"))


def field_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.heading(F.col("html")).alias("heading"))
    rules = {"title": {"required": True, "min": 20, "max": 70}, "heading": {"required": True, "pattern": "^[A-Z]"}}
    return structured.check_fields(rows, rules).select("page_id", F.array_join("violations", "; ").alias("violations"))


def listing_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"label": F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')), "tags": F.array("p_type", "p_brand")})
    return sinks.csv_lines(rows, "p_partkey", "label", "tags")


def metric_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.metric_lines(rows, "events_total", "event_type", "n")


def upserted_customers(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    new = old.filter("c_custkey % 10 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "c_name": F.lit("changed")})
    new = new.union(new.withColumn("c_custkey", -F.col("c_custkey") - 1))
    return sinks.upsert(old, new, ["c_custkey"], ["c_acctbal"])


def retry_delays(spark, sf_dir):
    rows = operations.failure_runs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")
    return rows.groupBy("length").agg(F.count("*").alias("n_runs")).select("length", "n_runs", sinks.backoff(F.col("length"), 200, 5000).alias("delay_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        container_scores, chosen_containers, page_metadata, page_policies, field_checks, listing_lines, metric_lines,
        upserted_customers, retry_delays,
    )
}

_FOUND = " UNION ALL ".join(
    rf"SELECT page_id, '{t}' AS tag, unnest(l) AS x, unnest(range(len(l)))::INTEGER AS no FROM (SELECT page_id, regexp_extract_all(html, '<{t}(?:\s[^>]*)?>[\s\S]*?</{t}>', 0, 'i') AS l FROM pages)"
    for t in structured.CONTAINERS
)


def _attribute(name: str) -> str:
    return rf"""regexp_extract(regexp_extract(x, '^<[^>]*>'), '\b{name}\s*=\s*["'']?([^"''>\s]*)', 1, 'i')"""


_NAMED = " + ".join([f"CASE WHEN contains(names, '{n}') THEN -5 ELSE 0 END" for n in structured.BAD_NAMES] + [f"CASE WHEN contains(names, '{n}') THEN 3 ELSE 0 END" for n in structured.GOOD_NAMES])
_SCORED = rf"""WITH f AS ({_FOUND}),
i AS (SELECT page_id, tag, no, tag IN ('article', 'main', 'section') AS candidate, lower(concat_ws(' ', nullif({_attribute('class')}, ''), nullif({_attribute('id')}, ''))) AS names,
  regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '<!--[\s\S]*?-->', '', 'g') AS inner_html FROM f),
m AS (SELECT page_id, tag, no, candidate, names, length({decoded_sql("inner_html", False)})::INTEGER AS length, len(regexp_extract_all(inner_html, '<p(?:\s[^>]*)?>', 0, 'i'))::INTEGER AS paragraphs,
  coalesce(list_sum(list_transform(regexp_extract_all(inner_html, '<(?:a)(?:\s[^>]*)?>([^<]*)', 1, 'i'), lambda x: length({decoded_sql("x", False)}))), 0)::INTEGER AS linked FROM i),
s AS (SELECT *, least(length / 1000, 5.0) + paragraphs * 2 - CASE WHEN length > 0 THEN linked / length ELSE 0.0 END * 10 + {_NAMED} AS score FROM m)"""
_RUN = """WITH r AS (SELECT user_id, ts, event_type = 'error' AS f, row_number() OVER o - sum((event_type = 'error')::INTEGER) OVER o AS run FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT count(*) AS length FROM r WHERE f GROUP BY user_id, run)"""
_CASES = " ".join("WHEN regexp_matches(h, '^{}$') THEN '{}'".format(g.replace(".", r"\.").replace("*", ".*"), n) for n, g in POLICIES)
ORACLE_SQL = {
    "container_scores": f"{_SCORED} SELECT page_id, tag, no, candidate, names, length, paragraphs, linked, round(score::DOUBLE, 6) AS score FROM s",
    "chosen_containers": f"""{_SCORED}, g AS (SELECT *, row_number() OVER o AS place, round(coalesce(sum(score::DOUBLE) OVER (PARTITION BY page_id ORDER BY score DESC, tag, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS b,
  round(sum(score::DOUBLE) OVER (PARTITION BY page_id) * 0.7, 9) AS t FROM s WHERE score > 0 AND candidate WINDOW o AS (PARTITION BY page_id ORDER BY score DESC, tag, no))
SELECT page_id, tag, no, place::INTEGER AS place, round(score::DOUBLE, 6) AS score FROM g WHERE b < t""",
    "page_metadata": r"""WITH m AS (SELECT page_id, len(regexp_extract_all(html, '<script[^>]*application/ld\+json[^>]*>([\s\S]*?)</script>', 1, 'i')) AS j,
  len(list_distinct(regexp_extract_all(html, '<meta\s[^>]*(og:[a-z:_]+)', 1, 'i'))) AS o FROM pages)
SELECT page_id, j::INTEGER AS n_json_ld, o::INTEGER AS n_open_graph, (CASE WHEN j > 0 THEN 0.4 ELSE 0.0 END + CASE WHEN o > 0 THEN 0.3 ELSE 0.0 END)::DOUBLE AS confidence FROM m""",
    "page_policies": f"WITH p AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS h FROM pages) SELECT page_id, CASE {_CASES} ELSE 'default' END AS policy FROM p",
    "field_checks": r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)', 1, 'i'), '\s+', ' ', 'g')) AS t,
  trim(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1, 'i'), '\s+', ' ', 'g')) AS h FROM pages)
SELECT page_id, concat_ws('; ', CASE WHEN t = '' THEN 'title is required' END, CASE WHEN t <> '' AND length(t) < 20 THEN 'title is too short' END, CASE WHEN length(t) > 70 THEN 'title is too long' END,
  CASE WHEN h = '' THEN 'heading is required' END, CASE WHEN h <> '' AND NOT regexp_matches(h, '^[A-Z]') THEN 'heading has another form' END) AS violations FROM p""",
    "listing_lines": "SELECT concat(p_partkey, ',', chr(34), p_name, ', ', repeat(chr(34), 2), p_brand, repeat(chr(34), 3), ',', p_type, '|', p_brand) AS line FROM part",
    "metric_lines": """SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "upserted_customers": """SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT -c_custkey - 1, 'changed', c_nationkey, c_acctbal + 1, c_mktsegment FROM customer WHERE c_custkey % 10 = 0""",
    "retry_delays": f"{_RUN} SELECT length, count(*) AS n_runs, least(pow(2, length) * 200, 5000)::BIGINT AS delay_ms FROM l GROUP BY 1",
}
