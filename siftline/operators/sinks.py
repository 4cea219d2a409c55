"""Shapes that sinks write: listing rows, event lines, metric text and upserts."""

import functools

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.urls import url_key

SNAPSHOT = "url string, url_key string, content_hash string, content string, ts timestamp, part string"


def csv_value(x: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line break; quotes doubled; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


# Columns of a listing file.
LISTING_COLUMNS = (
    "id", "marketplace", "url", "title", "description", "price_amount", "price_currency", "original_price_amount",
    "original_price_currency", "shipping_cost_amount", "shipping_cost_currency", "condition", "availability", "sold_date",
    "quantity_available", "seller_id", "seller_name", "seller_rating", "seller_review_count", "seller_verified", "images",
    "item_number", "category", "extracted_at", "extraction_method", "confidence", "raw_data_hash", "extractor_version",
)


def listing_rows(rows: DataFrame, **fields: Column) -> DataFrame:
    """All columns of a listing file, in order: those given, and empty ones for the rest."""
    return rows.select(*[fields.get(c, F.lit(None).cast("string")).alias(c) for c in LISTING_COLUMNS])


def append_json(rows: DataFrame, path: str, *by: str) -> None:
    """Append rows as lines of JSON, a folder for each value of `by`; null fields are left out."""
    rows.write.mode("append").partitionBy(*by).json(path)


def save_snapshots(pages: DataFrame, path: str, url: str, content: str, ts: str) -> None:
    """Append versions of pages (url, content, ts), 256 folders by the start of the URL's key; the key, the content's hash
    and the time are kept with each."""
    key = url_key(F.col(url))
    pages.select(
        F.col(url).alias("url"), key.alias("url_key"), F.sha2(content, 256).alias("content_hash"), F.col(content).alias("content"), F.col(ts).alias("ts"),
        F.substring(key, 1, 2).alias("part"),
    ).write.mode("append").partitionBy("part").parquet(path)


def latest_snapshots(spark, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """The newest version of each page, its folder left out."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy("url_key").agg(F.max_by(F.struct("url", "content_hash", "content", "ts"), "ts").alias("v"), F.count("*").alias("versions")).select("url_key", "v.*", "versions")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, line): a report's sections, each row a line of JSON, as one table to write as text or JSON."""
    out = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("line")) for name, df in parts.items()]
    return functools.reduce(DataFrame.union, out)


def csv_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """(line): arrays are joined by |."""
    kinds = dict(rows.dtypes)
    values = [F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c) for c in columns]
    return rows.select(F.concat_ws(",", *[csv_value(v) for v in values]).alias("line"))


def event_lines(rows: DataFrame, kind: str) -> DataFrame:
    """(line): one JSON object for each row, with its kind; null fields are left out."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct("*").alias("payload"))).alias("line"))


def metric_lines(rows: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """(line): metrics in the text exposition format."""
    line = F.concat(F.lit(f'{name}{{{label}="'), F.col(label).cast("string"), F.lit('"} '), F.col(value).cast("string"))
    return rows.select(line.alias("line"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, `updated` columns come from `new` and all others stay. One full join."""
    o = old.select([F.col(c).alias(f"_o_{c}") for c in old.columns] + [F.lit(True).alias("_old")])
    n = new.select([F.col(c).alias(f"_n_{c}") for c in old.columns] + [F.lit(True).alias("_new")])
    same = [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys]
    both = o.join(n, same, "full")

    def pick(c: str) -> Column:
        first, second = ("_n_", "_o_") if c in updated else ("_o_", "_n_")
        has = F.col("_new") if c in updated else F.col("_old")
        return F.when(has, F.col(f"{first}{c}")).otherwise(F.col(f"{second}{c}")).alias(c)

    return both.select([pick(c) for c in old.columns])


def backoff(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    """min(base * 2^attempt, cap), without jitter."""
    return F.least(F.pow(F.lit(2.0), attempt) * base_ms, F.lit(float(cap_ms))).cast("long")
