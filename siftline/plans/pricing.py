"""Queries on prices and other measured values."""

from pyspark.sql import functions as F

from siftline.operators import pricing
from siftline.plans.extraction import table

AS_OF = "2001-01-01 00:00:00"


def _rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


_STATS = ("mean", "median", "std_dev", "variance", "range", *[f"p{p}" for p in pricing.PERCENTILES])


def price_statistics(spark, sf_dir):
    return _rounded(pricing.statistics(table(spark, sf_dir, "part"), "p_retailprice"), *_STATS, digits=3)


def price_statistics_by_condition(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition"), F.col("l_quantity").alias("price"))
    return _rounded(pricing.statistics(rows, "price", "condition"), *_STATS, digits=3)


def _parts(spark, sf_dir):
    condition = F.when(F.col("p_type") == "ECONOMY", "used").otherwise("new")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice", condition.alias("condition"))


def price_deals(spark, sf_dir):
    condition = F.when(F.col("o_orderstatus") == "O", "new").otherwise("used")
    rows = table(spark, sf_dir, "orders").withColumn("condition", condition)
    return _rounded(pricing.deals(rows, "o_totalprice", "o_orderkey", "condition"), "savings_percent")


def price_trends(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice", F.col("o_orderdate").cast("timestamp").alias("sold"))
    out = pricing.trends(rows, "o_totalprice", "sold", F.lit(AS_OF).cast("timestamp"), 1500)
    return _rounded(out, "recent_avg", "older_avg", "change_percent")


def price_confidence(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    out = pricing.confidence(rows, "p_retailprice", F.lit(True), F.col("p_type") != "ECONOMY", "p_brand")
    return _rounded(out, "cv", "confidence", digits=6)


def listing_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("price"))
    return _rounded(pricing.upper_median(rows, "price", "l_suppkey"), "average", digits=3)


def latency_statistics(spark, sf_dir):
    out = pricing.statistics(table(spark, sf_dir, "events"), "value", "event_type")
    return _rounded(out.select("event_type", "n", "min", "mean", "p50", "p95", "max"), "mean")


def corpus_statistics(spark, sf_dir):
    """Mean, population deviation, 95 % interval and effect size of text lengths by language."""
    rows = table(spark, sf_dir, "documents").groupBy("lang")
    out = rows.agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.stddev_pop("n_chars").alias("std_dev"))
    half = 1.96 * F.col("std_dev") / F.sqrt("n")
    out = out.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "effect": F.col("mean") / F.col("std_dev")})
    return _rounded(out, "mean", "std_dev", "ci_low", "ci_high", "effect")


def listing_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand")
    return _rounded(
        rows.agg(
            F.count("*").alias("n"), (F.sum(F.col("p_retailprice").cast("decimal(18,6)")).cast("double") / F.count("p_retailprice")).alias("average"), F.min("p_retailprice").alias("min"),
            F.max("p_retailprice").alias("max"), F.stddev_pop("p_retailprice").alias("std_dev"),
            F.countDistinct("p_retailprice").alias("n_prices"),
        ),
        "average", "std_dev", digits=6,
    )


QUERIES = {
    f.__name__: f
    for f in (
        price_statistics, price_statistics_by_condition, price_deals, price_trends, price_confidence, listing_prices,
        latency_statistics, corpus_statistics, listing_sample,
    )
}


def _stats_sql(source: str, x: str, key: str = "") -> str:
    k, group, on = (f"{key} AS condition, ", "GROUP BY condition", "USING (condition)") if key else ("", "", "ON TRUE")
    head = "condition, " if key else ""
    pct = ", ".join(f"round(quantile_disc({x}, {p / 100}), 3) AS p{p}" for p in pricing.PERCENTILES)
    part = "PARTITION BY condition" if key else ""
    return f"""WITH s AS (SELECT {k}count({x}) AS n, round(avg({x}), 3) AS mean, round(quantile_cont({x}, 0.5), 3) AS median, min({x}) AS min, max({x}) AS max,
  round(stddev_pop({x}), 3) AS std_dev, round(var_pop({x}), 3) AS variance, round(max({x}) - min({x}), 3) AS range, {pct} FROM {source} {group}),
c AS (SELECT {k}{x} AS v, count(*) AS c FROM {source} GROUP BY ALL),
m AS (SELECT {head}CASE WHEN c > 1 THEN v END AS mode FROM (SELECT *, row_number() OVER ({part} ORDER BY c DESC, v) AS r FROM c) WHERE r = 1)
SELECT * FROM s JOIN m {on}"""


ORACLE_SQL = {
    "price_statistics": _stats_sql("part", "p_retailprice"),
    "price_statistics_by_condition": _stats_sql("lineitem", "l_quantity", "l_returnflag"),
    "price_deals": """WITH s AS (SELECT avg(o_totalprice) AS mean, quantile_disc(o_totalprice, 0.25) AS p25 FROM orders),
d AS (SELECT o_orderkey, o_totalprice AS price, (mean - o_totalprice) / mean * 100 AS v, p25, o_orderstatus FROM orders, s WHERE o_totalprice < mean * 0.85),
t AS (SELECT *, floor(v * 10 + 0.5)::BIGINT AS k FROM d)
SELECT o_orderkey, price, round(v, 4) AS savings_percent, (k // 10) || '.' || (k % 10) || '% below average'
  || CASE WHEN price < p25 THEN ' (bottom 25%)' ELSE '' END || CASE WHEN o_orderstatus = 'O' THEN ' + NEW condition!' ELSE '' END AS reason
FROM t ORDER BY v DESC, o_orderkey LIMIT 10""",
    "price_trends": f"""WITH a AS (SELECT o_totalprice AS p, (epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate)) / 86400 AS age FROM orders WHERE o_orderdate IS NOT NULL),
b AS (SELECT count(*) AS n, avg(p) FILTER (age <= 750) AS r, avg(p) FILTER (age > 750 AND age <= 1500) AS o FROM a)
SELECT n, round(r, 4) AS recent_avg, round(o, 4) AS older_avg, round((r - o) / o * 100, 4) AS change_percent,
  CASE WHEN (r - o) / o * 100 > 5 THEN 'up' WHEN (r - o) / o * 100 < -5 THEN 'down' ELSE 'stable' END AS direction
FROM b WHERE n >= 10 AND r IS NOT NULL AND o IS NOT NULL""",
    "price_confidence": """WITH g AS (SELECT p_brand, count(*) AS n, avg(CASE WHEN p_type <> 'ECONOMY' THEN 1 ELSE 0 END) AS k, stddev_pop(p_retailprice) / avg(p_retailprice) AS cv FROM part GROUP BY 1)
SELECT p_brand, n, round(cv, 6) AS cv, round(least(CASE WHEN n >= 50 THEN 0.4 WHEN n >= 20 THEN 0.3 WHEN n >= 10 THEN 0.2 ELSE 0.1 END + 0.3 + k * 0.2
  + CASE WHEN cv < 0.2 THEN 0.1 WHEN cv < 0.4 THEN 0.05 ELSE 0.0 END, 1.0), 6) AS confidence FROM g""",
    "listing_prices": """SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS low, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median,
  max(l_extendedprice) AS high, round(avg(l_extendedprice), 3) AS average FROM lineitem GROUP BY 1""",
    "latency_statistics": """SELECT event_type, count(*) AS n, min(value) AS min, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max
FROM events GROUP BY 1""",
    "corpus_statistics": """WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY 1)
SELECT lang, n, round(m, 4) AS mean, round(s, 4) AS std_dev, round(m - 1.96 * s / sqrt(n), 4) AS ci_low, round(m + 1.96 * s / sqrt(n), 4) AS ci_high, round(m / s, 4) AS effect FROM g""",
    "listing_sample": """SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS average, min(p_retailprice) AS min, max(p_retailprice) AS max,
  round(stddev_pop(p_retailprice), 6) AS std_dev, count(DISTINCT p_retailprice) AS n_prices FROM part GROUP BY 1""",
}
