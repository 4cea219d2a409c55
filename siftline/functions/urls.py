"""URLs: links of a page, normal form, hashes and crawl filters."""

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

HREF = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
#: Schemes that are no pages.
SKIPPED = "^(javascript:|mailto:|tel:|data:)"


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)(https?://[^/?#]+)", 1))


def normalise(url: Column) -> Column:
    """http(s) only: no fragment, sorted query pairs, no slash at the end but the root's. Else an empty string."""
    bare = F.regexp_replace(url, "#.*$", "")
    base = F.regexp_extract(bare, r"^[^?]*", 0)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda x: x != ""))
    sorted_ = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    host, path = origin(base), F.regexp_replace(base, r"^(?i)https?://[^/?#]+", "")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), sorted_)
    trimmed = F.when((path != "/") & whole.endswith("/") & (path != ""), F.regexp_replace(whole, "/$", "")).otherwise(whole)
    return F.when(host == "", F.lit("")).otherwise(trimmed)


def resolve(href: Column, base: Column) -> Column:
    """Absolute and root-relative links; others are read from the root."""
    return (
        F.when(href.rlike("^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(?i)(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .otherwise(F.concat(origin(base), F.lit("/"), href))
    )


def links(html: Column, base: Column) -> Column:
    """Distinct links in order of appearance."""
    raw = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "^[\"']|[\"']$", "")))
    pages = F.filter(raw, lambda x: (x != "") & (x != "#") & ~x.rlike(SKIPPED))
    return F.array_distinct(F.filter(F.transform(pages, lambda x: normalise(resolve(x, base))), lambda x: x != ""))


def url_key(url: Column) -> Column:
    """16 hex digits that equal URLs share whatever their case and last slash."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(url)), "/+$", ""), 256), 1, 16)


def passes(url: Column, host: Column, prefix: str, include: list[str], exclude: list[str]) -> Column:
    """Same host, path below a prefix, any of the wanted patterns and none of the unwanted."""
    same = origin(url) == host
    path = F.regexp_replace(url, r"^(?i)https?://[^/?#]+", "")
    wanted = F.greatest(*[url.rlike(p) for p in include], F.lit(not include))
    unwanted = F.greatest(*[url.rlike(p) for p in exclude], F.lit(False))
    return same & path.startswith(prefix) & wanted & ~unwanted


#: UTF-16 units hashed at once, and the powers of 31 for them, highest first.
BLOCK = 1 << 16


@functools.cache
def _powers() -> np.ndarray:
    out = np.full(BLOCK, 31, np.uint32)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint32)[::-1].copy()


def _hash(text: str) -> int:
    units, powers, h = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32), _powers(), 0
    for lo in range(0, len(units), BLOCK):
        some = units[lo : lo + BLOCK]
        h = (h * pow(31, len(some), 1 << 32) + int((some * powers[-len(some) :]).sum(dtype=np.uint32))) % (1 << 32)
    return h - (1 << 32) if h >= 1 << 31 else h


def _hashes(texts: pd.Series) -> pd.Series:
    return pd.Series([_hash(x) for x in texts], dtype="int64")


def rolling_hash(text: Column) -> Column:
    """The 32-bit hash h = h * 31 + unit over UTF-16 units, as a signed integer: a character beyond the basic plane counts
    as its two surrogates."""

    return F.pandas_udf(_hashes, LongType())(F.coalesce(text, F.lit("")))


def rollout(text: Column, percent: Column) -> Column:
    return F.abs(rolling_hash(text)) % 100 < percent
