"""The library's scalar functions for SQL text: `register(spark)` makes them callable by name.

They are SQL functions, so Catalyst inlines their bodies and no Python runs for them; the table function reads pages.
"""

from pyspark.sql import SparkSession

# name: (arguments, type, body)
FUNCTIONS = {
    "sift_url_key": ("url STRING", "STRING", "substr(sha2(regexp_replace(lower(trim(url)), '/+$', ''), 256), 1, 16)"),
    "sift_tokens": ("text STRING", "BIGINT", "CAST(ceil(length(text) / 4) AS BIGINT)"),
    "sift_backoff": ("attempt INT, base_ms BIGINT, cap_ms BIGINT", "BIGINT", "CAST(least(pow(2.0, attempt) * base_ms, cap_ms) AS BIGINT)"),
    "sift_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D "
        "ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) "
        "/ (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END",
    ),
    "sift_price": ("text STRING", "DOUBLE", "try_cast(replace(regexp_extract(text, '([0-9,]+[.]?[0-9]*)', 1), ',', '') AS DOUBLE)"),
}
TABLES = {
    "sift_links": (
        "html STRING",
        "link_no INT, href STRING",
        "SELECT posexplode(regexp_extract_all(html, '(?i)<a\\\\s[^>]*?href\\\\s*=\\\\s*\"([^\"]*)\"', 1)) AS (link_no, href)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Names of the functions, which live as long as the session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (args, kind, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({kind}) RETURN {body}")
    return [*FUNCTIONS, *TABLES]
