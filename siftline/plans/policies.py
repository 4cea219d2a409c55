"""Queries on policies and settings by host."""

from pyspark.sql import functions as F

from siftline.operators import policies as ops
from siftline.plans.extraction import table

POLICIES = [
    {
        "name": "news", "domain": "www.*|news.*", "keep": [{"selector": "article"}],
        "drop": [{"selector": "script"}, {"selector": "style"}, {"selector": "div.ad"}, {"regex": "[Aa]d "}], "fields": {"title": {"required": True}},
    },
    {"name": "blogs", "domain": "blog.*", "keep": [{"selector": "h1"}, {"selector": "footer"}], "drop": [{"selector": "nav"}, {"regex": "lorem|[0-9]{3}"}]},
    {"name": "default", "domain": "*", "drop": [{"selector": "nav"}, {"selector": "footer"}, {"selector": "script"}]},
]
HOSTS = {"*.example": {"delay": 3}, "www.*": {"delay": 2}, "blog.*": {"delay": 7}}


def applied_policies(spark, sf_dir):
    return ops.apply(table(spark, sf_dir, "pages"), POLICIES, "page_id")


def policy_list(spark, sf_dir):
    """The policies, and how many pages each is for."""
    rows = [(p["name"], p["domain"], len(p.get("keep", [])) + len(p["drop"]), len(ops.errors(p)), ops.fingerprint([p])) for p in POLICIES]
    listed = spark.createDataFrame(rows, "name string, domain string, n_rules int, n_errors int, fingerprint string")
    chosen = ops.select_policy(F.col("url"), [(p["name"], p["domain"]) for p in POLICIES[:-1]], POLICIES[-1]["name"])
    used = table(spark, sf_dir, "pages").groupBy(chosen.alias("name")).agg(F.count("*").alias("n_pages"))
    return listed.join(used, "name", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))


def host_delays(spark, sf_dir):
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", ops.setting(host, HOSTS, "delay", 1).alias("delay"))


def table_policies(spark, sf_dir):
    """Pages of customers' shops, by patterns that are a table: some for each customer, some for all."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    glob = F.when(k % 5 == 0, F.concat(F.lit("*.c"), k, F.lit(".example"))).when(k % 5 == 1, F.concat(F.lit("www.c"), k, F.lit(".*"))).when(k % 5 == 2, F.concat(F.lit("c"), k, F.lit(".example")))
    glob = glob.when(k % 5 == 3, F.concat(F.lit("m.c"), k, F.lit(".*|*.c"), k, F.lit(".test"))).otherwise(F.concat(F.lit("*c"), k, F.lit("0*")))
    patterns = customers.select(F.concat(F.lit("p"), k).alias("name"), (-k).alias("place"), glob.alias("pattern"))
    every = spark.createDataFrame([("news", 1, "www.*|*.news"), ("mobile", 2, "m.*")], "name string, place long, pattern string")
    host = F.concat(F.element_at(F.array(*map(F.lit, ("www.", "m.", "", "a.b."))), (k % 4 + 1).cast("int")), F.lit("c"), k * 7 % 1000, F.element_at(F.array(*map(F.lit, (".example", ".test", ".news"))), (k % 3 + 1).cast("int")))
    pages = customers.select("c_custkey", F.concat(F.lit("https://"), host, F.lit("/x?y=z")).alias("url"))
    return ops.match(pages, "url", patterns.union(every), "default")


QUERIES = {f.__name__: f for f in (applied_policies, policy_list, host_delays, table_policies)}


def _tag(selector: str) -> str:
    tag, _, cls = selector.partition(".")
    head = rf"""<{tag}(?:\s[^>]*)?>""" if not cls else rf"""<{tag}(?:\s[^>]*)?\sclass\s*=\s*["'''](?:[^"''>]*\s)?{cls}(?:\s[^"''>]*)?["''][^>]*>""".replace("'''", "''")
    return rf"{head}[\s\S]*?</{tag}>"


def _steps(p: dict, k: int) -> str:
    """Three columns a step: the page, and what matched so far, one rule after another."""
    sql, n = f"SELECT page_id, html, 0 AS n FROM p WHERE policy = '{p['name']}'", 0
    rules = [(_tag(r["selector"]), "", "i") for r in p["drop"] if "selector" in r] + [(f">[^<]*(?:{r['regex']})[^<]*<", "><", "") for r in p["drop"] if "regex" in r]
    for rx, by, flag in rules:
        sql = f"SELECT page_id, regexp_replace(html, '{rx}', '{by}', 'g{flag}') AS html, n + len(regexp_extract_all(html, '{rx}', 0, '{flag or 'c'}')) AS n FROM ({sql})"
    if p.get("keep"):
        kept = " || ".join(f"regexp_extract_all(html, '{_tag(r['selector'])}', 0, 'i')" for r in p["keep"])
        sql = f"SELECT page_id, CASE WHEN len(k) > 0 THEN '<body>' || array_to_string(k, '') || '</body>' ELSE html END AS html, n + len(k) AS n FROM (SELECT *, {kept} AS k FROM ({sql}))"
    return f"SELECT page_id, '{p['name']}' AS policy, html, n::INTEGER AS rules_matched FROM ({sql})"


_HOST = "regexp_extract(lower(url), '^https?://([^/?#:]+)', 1)"
ORACLE_SQL = {
    "applied_policies": f"""WITH h AS (SELECT page_id, html, {_HOST} AS h FROM pages),
p AS (SELECT *, CASE WHEN regexp_matches(h, '^www\\..*|news\\..*$') THEN 'news' WHEN regexp_matches(h, '^blog\\..*$') THEN 'blogs' ELSE 'default' END AS policy FROM h)
"""
    + " UNION ALL ".join(_steps(p, k) for k, p in enumerate(POLICIES)),
    "policy_list": rf"""WITH u AS (SELECT CASE WHEN regexp_matches(h, '^www\..*|news\..*$') THEN 'news' WHEN regexp_matches(h, '^blog\..*$') THEN 'blogs' ELSE 'default' END AS name, count(*) AS n_pages FROM (SELECT {_HOST} AS h FROM pages) GROUP BY 1)
SELECT t.*, coalesce(n_pages, 0) AS n_pages FROM (VALUES """
    + ", ".join(f"('{p['name']}', '{p['domain']}', {len(p.get('keep', [])) + len(p['drop'])}::INTEGER, 0::INTEGER, '{ops.fingerprint([p])}')" for p in POLICIES)
    + ") t(name, domain, n_rules, n_errors, fingerprint) LEFT JOIN u USING (name)",
    "table_policies": r"""WITH c AS (SELECT c_custkey AS k FROM customer), p AS (
  SELECT 'p' || k AS name, -k AS place, CASE k % 5 WHEN 0 THEN '*.c' || k || '.example' WHEN 1 THEN 'www.c' || k || '.*' WHEN 2 THEN 'c' || k || '.example' WHEN 3 THEN 'm.c' || k || '.*|*.c' || k || '.test' ELSE '*c' || k || '0*' END AS g FROM c
  UNION ALL VALUES ('news', 1, 'www.*|*.news'), ('mobile', 2, 'm.*')
), r AS (SELECT name, place, '^' || replace(replace(g, '.', '\.'), '*', '.*') || '$' AS r FROM p),
h AS (SELECT k, ['www.', 'm.', '', 'a.b.'][k % 4 + 1] || 'c' || (k * 7 % 1000) || ['.example', '.test', '.news'][k % 3 + 1] AS host FROM c),
f AS (SELECT host, arg_min(name, (place, name)) AS name FROM (SELECT DISTINCT host FROM h) JOIN r ON regexp_matches(host, r) GROUP BY 1)
SELECT k AS c_custkey, 'https://' || host || '/x?y=z' AS url, coalesce(name, 'default') AS policy FROM h LEFT JOIN f USING (host)""",
    "host_delays": rf"""SELECT page_id, CASE WHEN regexp_matches(h, '^.*\.example$') THEN 3 WHEN regexp_matches(h, '^www\..*$') THEN 2 WHEN regexp_matches(h, '^blog\..*$') THEN 7 ELSE 1 END::INTEGER AS delay
FROM (SELECT page_id, {_HOST} AS h FROM pages)""",
}
