"""Queries on admission: limiters, quotas' buckets and breakers over the calls of each user."""

from pyspark.sql import functions as F

from siftline.operators import admission as ops
from siftline.plans.extraction import table

LIMIT, WINDOW = 2, 86_400
BUCKETS = [(1, 3_600), (2, 86_400), (5, 604_800)]
CAPACITY, DAY = 3.0, 86_400


def token_bucket(spark, sf_dir):
    return ops.token_bucket(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", CAPACITY, 1 / DAY)


def circuit_breaker(spark, sf_dir):
    return ops.circuit_breaker(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 2, float(DAY))


def sliding_window_limit(spark, sf_dir):
    return ops.sliding_window(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", LIMIT, WINDOW)


def several_buckets_limit(spark, sf_dir):
    return ops.several_buckets(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", BUCKETS)


QUERIES = {f.__name__: f for f in (token_bucket, circuit_breaker, sliding_window_limit, several_buckets_limit)}

_CALLS = """e AS (SELECT user_id, event_id, event_type = 'error' AS bad, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""


def _buckets_sql() -> str:
    first = ", ".join(f"{n - 1} AS l{i}, tm AS s{i}" for i, (n, _) in enumerate(BUCKETS))
    filled = ", ".join(
        f"CASE WHEN e.tm - f.s{i} >= {s}000000 THEN {n} ELSE f.l{i} END AS l{i}, f.s{i} + (e.tm - f.s{i}) // {s}000000 * {s}000000 AS s{i}"
        for i, (n, s) in enumerate(BUCKETS)
    )
    empty = "CASE " + " ".join(f"WHEN l{i} < 1 THEN {i}" for i in range(len(BUCKETS))) + " ELSE -1 END"
    took = ", ".join(f"CASE WHEN d < 0 THEN l{i} - 1 ELSE l{i} END AS l{i}, s{i}" for i in range(len(BUCKETS)))
    return f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, event_id, k, {first}, -1 AS d FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, {took}, d FROM (SELECT *, {empty} AS d FROM (SELECT e.user_id, e.event_id, e.k, {filled} FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
) SELECT user_id, event_id, d < 0 AS allowed, d::BIGINT AS denied_by FROM f"""


ORACLE_SQL = {
    "token_bucket": f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, event_id, k, tm, {CAPACITY}::DOUBLE - 1 AS tokens, true AS ok FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, tm, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1
  FROM (SELECT e.user_id, e.event_id, e.k, e.tm, least({CAPACITY}::DOUBLE, f.tokens + (e.tm - f.tm) / 1000000::DOUBLE * (1 / {DAY}::DOUBLE)) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
) SELECT user_id, event_id, ok AS allowed, floor(tokens)::BIGINT AS remaining FROM f""",
    "circuit_breaker": f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, event_id, k, 'closed' AS state, bad::INTEGER AS run, 0::BIGINT AS opened, false AS rejected FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k,
    CASE WHEN s = 'open' THEN 'open' WHEN NOT bad THEN 'closed' WHEN s = 'half_open' OR run + 1 >= 2 THEN 'open' ELSE s END,
    CASE WHEN s = 'open' THEN run WHEN bad THEN run + 1 ELSE 0 END,
    CASE WHEN s <> 'open' AND bad AND (s = 'half_open' OR run + 1 >= 2) THEN tm ELSE opened END, s = 'open'
  FROM (SELECT e.user_id, e.event_id, e.k, e.bad, e.tm, f.run, f.opened, CASE WHEN f.state = 'open' AND e.tm - f.opened >= {DAY}000000 THEN 'half_open' ELSE f.state END AS s
    FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
) SELECT user_id, event_id, state, rejected FROM f""",
    "sliding_window_limit": f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, event_id, k, [tm] AS held, true AS ok, 0::BIGINT AS wait FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, CASE WHEN len(w) >= {LIMIT} THEN w ELSE list_append(w, tm) END, len(w) < {LIMIT},
    CASE WHEN len(w) >= {LIMIT} THEN ceil((w[1] + {WINDOW}000000 - tm) / 1000000)::BIGINT ELSE 0 END
  FROM (SELECT e.user_id, e.event_id, e.k, e.tm, list_filter(f.held, lambda x: x > e.tm - {WINDOW}000000) AS w FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
) SELECT user_id, event_id, ok AS allowed, wait AS retry_after FROM f""",
    "several_buckets_limit": _buckets_sql(),
}
