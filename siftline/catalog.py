"""All queries of the library with their SQL, by name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.plans import (
    admission, changes, events, exports, extraction, listings, marketplace, operations, policies, pricing, provenance, records, relational,
    requests, retrieval, stores, streams, structured, tables,
)

_PLANS = (
    extraction, events, provenance, retrieval, pricing, operations, admission, changes, listings, marketplace, structured, policies, requests,
    relational, exports, records, streams, stores, tables,
)

FLAGSHIP = "select_best_extraction"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for p in _PLANS for n, q in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for p in _PLANS for n, s in p.ORACLE_SQL.items()}
