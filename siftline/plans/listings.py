"""Queries on product listings. A part offered by several suppliers stands for a listing seen in several sources."""

from pyspark.sql import functions as F

from siftline.operators import listings
from siftline.plans.extraction import table


def parsed_prices(spark, sf_dir):
    sign = F.element_at(F.array(F.lit("$"), F.lit("£"), F.lit("€")), (F.col("p_size") % 3 + 1).cast("int"))
    text = F.concat(sign, F.format_number("p_retailprice", 2), F.lit(" each"))
    rows = table(spark, sf_dir, "part").select("p_partkey", listings.price(text).alias("p"), F.concat("p_type", F.lit(" "), "p_name").alias("c"))
    return rows.select("p_partkey", F.col("p.amount").alias("amount"), F.col("p.currency").alias("currency"), listings.condition(F.col("c")).alias("condition"))


def _candidates(spark, sf_dir):
    names = list(listings.CHANNELS)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("quantity"))
    k = (F.col("l_suppkey") % len(names)).cast("int")

    def of(i):
        return F.element_at(F.array(*[F.lit(v[i]) for v in listings.CHANNELS.values()]), k + 1)

    rows = rows.groupBy("l_partkey", k.alias("k")).agg(F.min("l_suppkey").alias("l_suppkey"), F.max("price").alias("price"), F.max("quantity").alias("quantity"))
    k = F.col("k")
    return rows.select(
        "l_partkey", "price", "quantity", F.element_at(F.array(*map(F.lit, names)), k + 1).alias("channel"), of(0).alias("tier"),
        of(1).alias("confidence"), ((F.col("l_suppkey") * 7 % 10) / 10).alias("reliability"), (F.col("l_suppkey") % 4 != 0).alias("available"),
    )


def source_fallback(spark, sf_dir):
    out = listings.best_source(_candidates(spark, sf_dir), "l_partkey", 0.55)
    return out.select("l_partkey", "channel", "tier", "price", "fallback_used")


def merged_listings(spark, sf_dir):
    out = listings.merge(_candidates(spark, sf_dir), "l_partkey", "price", "quantity")
    return out.withColumn("confidence", F.round("confidence", 6))


def validated_listings(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"brand": F.when(F.col("p_size") % 5 > 0, F.col("p_brand")), "confidence": F.lit(0.8)})
    out = listings.validate(rows, ["p_name", "p_retailprice"], ["brand"], ["p_type"], {"price too high": F.col("p_retailprice") < 990})
    return out.select(
        "p_partkey", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"),
        F.round("capture_rate", 6).alias("capture_rate"), "is_valid", F.round("adjusted", 6).alias("adjusted"),
    )


QUERIES = {f.__name__: f for f in (parsed_prices, source_fallback, merged_listings, validated_listings)}


def _pick(i: int) -> str:
    return "[" + ", ".join(f"{v[i]!r}" for v in listings.CHANNELS.values()) + "][k + 1]"


_CAND = f"""g AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS price, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
h AS (SELECT l_partkey, (l_suppkey % {len(listings.CHANNELS)})::INTEGER AS k, min(l_suppkey) AS s, max(price) AS price, max(quantity) AS quantity FROM g GROUP BY 1, 2),
c AS (SELECT l_partkey, price, quantity, {list(listings.CHANNELS)!r}[k + 1] AS channel, {_pick(0)}::INTEGER AS tier, {_pick(1)}::DOUBLE AS confidence, (s * 7 % 10) / 10 AS reliability, s % 4 <> 0 AS available FROM h)"""
ORACLE_SQL = {
    "parsed_prices": """WITH x AS (SELECT p_partkey, round(p_retailprice, 2) AS amount, ['USD', 'GBP', 'EUR'][p_size % 3 + 1] AS currency, lower(p_type || ' ' || p_name) AS c FROM part)
SELECT p_partkey, amount, currency, CASE WHEN contains(c, 'refurbished') THEN 'refurbished' WHEN contains(c, 'new') THEN 'new' WHEN contains(c, 'very good') THEN 'used_very_good'
  WHEN contains(c, 'good') THEN 'used_good' WHEN contains(c, 'acceptable') THEN 'used_acceptable' WHEN contains(c, 'used') THEN 'used_good' ELSE 'unknown' END AS condition FROM x""",
    "source_fallback": f"""WITH {_CAND}, f AS (SELECT *, min(tier) OVER (PARTITION BY l_partkey) AS first FROM c)
SELECT l_partkey, channel, tier, price, tier > first AS fallback_used FROM f WHERE available AND confidence >= 0.55
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY tier, reliability DESC, channel) = 1""",
    "merged_listings": f"""WITH {_CAND}
SELECT l_partkey, arg_min(price, tier) AS price, arg_min(quantity, tier) AS quantity, count(*) AS n_sources,
  concat_ws(',', CASE WHEN min(price) <> max(price) THEN 'price' END, CASE WHEN min(quantity) <> max(quantity) THEN 'quantity' END) AS conflicts,
  round(least(arg_min(confidence, tier) + least((count(*) - 1) * 0.03, 0.1), 1.0), 6) AS confidence FROM c GROUP BY 1""",
    "validated_listings": """WITH x AS (SELECT *, CASE WHEN p_size % 5 > 0 THEN p_brand END AS brand FROM part),
e AS (SELECT *, CASE WHEN p_retailprice < 990 THEN '' ELSE 'price too high' END AS errors, CASE WHEN brand IS NULL THEN 'no brand' ELSE '' END AS warnings, (3 + (brand IS NOT NULL)::INTEGER) / 3 AS rate FROM x)
SELECT p_partkey, errors, warnings, round(rate, 6) AS capture_rate, errors = '' AND rate >= 0.7 AS is_valid,
  round(greatest(0.8 - 0.15 * (errors <> '')::INTEGER - 0.05 * (warnings <> '')::INTEGER, 0.0)::DOUBLE, 6) AS adjusted FROM e""",
}
