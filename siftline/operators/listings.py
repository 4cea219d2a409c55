"""Product listings: parsing of prices and conditions, validation, merging and fallback between sources."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Currency signs in order of precedence.
CURRENCIES = [("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("¥", "JPY")]
# Channels with their tier and the bounds of the confidence they may claim.
CHANNELS = {
    "official_api": (1, 0.95, 1.0),
    "data_export": (2, 0.9, 0.98),
    "email": (3, 0.8, 0.9),
    "scrape": (4, 0.6, 0.85),
    "llm": (5, 0.5, 0.8),
}


def price(text: Column) -> Column:
    """(amount, currency): the first number, thousands' commas dropped; USD where no sign is found."""
    amount = F.regexp_extract(text, r"([\d,]+\.?\d*)", 1)
    currency = F
    for sign, code in CURRENCIES:
        currency = currency.when(text.contains(sign), code)
    return F.struct(
        F.replace(amount, F.lit(","), F.lit("")).try_cast("double").alias("amount"),
        currency.otherwise("USD").alias("currency"),
    )


# Signs and codes that each shop's prices are read by, in order.
PRICE_RULES = {
    "ebay": [("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("US", "USD")],
    "amazon": [("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("CAD", "CAD")],
    "walmart": [("$", "USD"), ("USD", "USD")],
}
# Words for a condition by source, in order, and what none of them means.
CONDITION_RULES = {
    "amazon": (
        [
            ("new", "new"), ("refurbished", "refurbished"), ("used - like new", "used_like_new"), ("used - very good", "used_very_good"),
            ("used - good", "used_good"), ("used - acceptable", "used_acceptable"), ("used", "used_good"),
        ],
        "new",
    ),
    "walmart": ([("new", "new"), ("refurbished", "refurbished"), ("pre-owned", "used_good"), ("used", "used_good")], "new"),
    "analysis": ([("new", "new"), ("used", "used"), ("refurbished", "refurbished"), ("parts", "parts"), ("not working", "parts")], "unknown"),
}


def price_of(text: Column, shop: str) -> Column:
    """(amount, currency) as a shop's adapter reads it: USD where no sign of its own is found."""
    currency = F
    for sign, code in PRICE_RULES[shop]:
        currency = currency.when(text.contains(sign), code)
    return F.struct(price(text)["amount"].alias("amount"), currency.otherwise("USD").alias("currency"))


def condition_of(text: Column, source: str) -> Column:
    words, otherwise = CONDITION_RULES[source]
    x, out = F.lower(F.coalesce(text, F.lit(""))), F
    for word, value in words:
        out = out.when(x.contains(word), value)
    return out.otherwise(otherwise)


def money(amount: Column, currency: Column) -> Column:
    """Two decimals after the currency's sign; a dollar sign for all but pounds and euros."""
    sign = F.when(currency == "GBP", "£").when(currency == "EUR", "€").otherwise("$")
    return F.concat(sign, F.format_string("%.2f", amount))


def shipping(text: Column) -> Column:
    return F.when(F.lower(text).contains("free"), 0.0).otherwise(
        F.replace(F.regexp_extract(text, r"\$([\d,]+\.?\d*)", 1), F.lit(","), F.lit("")).try_cast("double")
    )


def condition(text: Column) -> Column:
    """As the scraping adapters have it: "like new" holds "new" and so counts as new."""
    x = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(x.contains("refurbished"), "refurbished")
        .when(x.contains("new"), "new")
        .when(x.contains("very good"), "used_very_good")
        .when(x.contains("good"), "used_good")
        .when(x.contains("acceptable"), "used_acceptable")
        .when(x.contains("used"), "used_good")
        .otherwise("unknown")
    )


def best_source(candidates: DataFrame, key: str, wanted: float) -> DataFrame:
    """The first available candidate of each key by tier and reliability that is confident enough, and whether it was a
    fallback (a worse tier than the first one tried)."""
    first = F.min("tier").over(W.partitionBy(key))
    rows = candidates.withColumn("_first", first).filter(F.col("available") & (F.col("confidence") >= wanted))
    order = W.partitionBy(key).orderBy("tier", F.desc("reliability"), "channel")
    best = rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    return best.withColumn("fallback_used", F.col("tier") > F.col("_first")).drop("_k", "_first")


def merge(candidates: DataFrame, key: str, *fields: str) -> DataFrame:
    """One listing of each key: fields from the best tier, fields that sources disagree on, and a small bonus for each
    further source (0.03, 0.1 at most). One aggregation with partial sums."""
    rank = F.struct("tier", "channel")
    rows = candidates.groupBy(key).agg(
        *[F.min_by(f, rank).alias(f) for f in fields],
        *[(F.min(f) != F.max(f)).alias(f"_{f}") for f in fields],
        F.count("*").alias("n_sources"),
        F.min_by("confidence", rank).alias("_c"),
    )
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"_{f}"), f) for f in fields]))
    sure = F.least(F.col("_c") + F.least((F.col("n_sources") - 1) * 0.03, F.lit(0.1)), F.lit(1.0))
    return rows.select(key, *fields, "n_sources", F.array_join(conflicts, ",").alias("conflicts"), sure.alias("confidence"))


def validate(listings: DataFrame, required: list[str], recommended: list[str], optional: list[str], checks: dict[str, Column]) -> DataFrame:
    """Issues of each listing, its capture rate (optional fields count when there, not when missing) and validity."""

    def there(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    errors = [F.when(~there(c), f"missing {c}") for c in required] + [F.when(~ok, name) for name, ok in checks.items()]
    warnings = [F.when(~there(c), f"no {c}") for c in recommended]
    captured = sum((there(c).cast("int") for c in [*required, *recommended, *optional]), F.lit(0))
    rows = listings.withColumns(
        {
            "errors": F.array_compact(F.array(*errors)),
            "warnings": F.array_compact(F.array(*warnings)),
            "capture_rate": captured / (len(required) + len(recommended)),
        }
    )
    ok = (F.size("errors") == 0) & (F.col("capture_rate") >= 0.7)
    drop = 0.15 * F.size("errors") + 0.05 * F.size("warnings")
    return rows.withColumns({"is_valid": ok, "adjusted": F.greatest(F.col("confidence") - drop, F.lit(0.0))})
