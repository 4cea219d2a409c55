"""Content addresses and source spans: made, compared and verified."""

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import html

SEPARATOR = "\n---METADATA---\n"
FORM = "^sha256:[a-f0-9]{64}$"


def address(body: Column, url: Column, content_type: Column) -> Column:
    """The content address of a page: its canonical body with its URL and type."""
    meta = F.concat(F.lit('{"url":"'), url, F.lit('","contentType":"'), content_type, F.lit('"}'))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(html.canonical_html(body), F.lit(SEPARATOR), meta), 256))


def verified(hash_: Column, body: Column, url: Column, content_type: Column) -> Column:
    return F.coalesce(hash_.rlike(FORM) & (hash_ == address(body, url, content_type)), F.lit(False))


def digest(hash_: Column) -> Column:
    """The hex digits of a valid address, else null."""
    return F.when(hash_.rlike(FORM), F.substring(hash_, 8, 64))


def same(a: Column, b: Column) -> Column:
    """Whether two addresses are valid and equal."""
    return F.coalesce(a.rlike(FORM) & (a == b), F.lit(False))


def storage_key(hash_: Column, prefix: str = "content:") -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(hash_), 1, 16))


def span(text: Column, page: Column) -> Column:
    """Where a text first stands in a page, in characters and in bytes; null where it doesn't."""
    at = F.instr(page, text) - 1
    before, part = F.substring(page, F.lit(1), at), text
    first = F.octet_length(before)
    whole = F.struct(at.alias("start"), (at + F.length(text)).alias("end"), first.alias("byte_start"), (first + F.octet_length(part)).alias("byte_end"))
    return F.when(at >= 0, whole)


def span_error(start: Column, end: Column, page: Column) -> Column:
    """Why a span of characters can't be one of the page; null if it can."""
    n = F.length(page)
    return (
        F.when((start < 0) | (end < 0), "negative offsets")
        .when((start > n) | (end > n), "offsets exceed the page")
        .when(start >= end, "start is not before end")
        .otherwise(F.lit(None).cast("string"))
    )


def verify_spans(spans: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, hash_matches, n_valid, n_invalid, valid) of each page's spans (span_no, start, end, content_hash): whether the
    first span's hash is that of the page as it is now, and whether all spans can be of it."""
    rows = spans.join(pages.select(key, "html"), key)
    checked = rows.select(key, "span_no", "content_hash", F.sha2("html", 256).alias("_now"), span_error(F.col("start"), F.col("end"), F.col("html")).isNull().alias("_ok"))
    out = checked.groupBy(key).agg(
        F.min_by(F.col("content_hash") == F.col("_now"), "span_no").alias("hash_matches"), F.count_if("_ok").alias("n_valid"), F.count_if(~F.col("_ok")).alias("n_invalid")
    )
    return out.withColumn("valid", F.col("hash_matches") & (F.col("n_invalid") == 0))
