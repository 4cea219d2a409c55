"""Queries on events and orders: quotas, queues, telemetry, health, metrics, limits."""

from pyspark.sql import functions as F

from siftline.operators import operations as ops
from siftline.plans.extraction import table

LIMIT = 20


def monthly_quota(spark, sf_dir):
    out = ops.monthly_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", LIMIT)
    return out.select("event_id", "user_id", "used", "allowed", "remaining", F.col("resets_at").cast("string").alias("resets_at"))


def recent_calls(spark, sf_dir):
    return ops.calls_in_window(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "user_id", "recent")


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("priority", 6 - F.substring("o_orderpriority", 1, 1).cast("int"))


def job_queue(spark, sf_dir):
    lane = F.col("o_custkey") % 16
    rows = _jobs(spark, sf_dir).filter("o_orderstatus <> 'F'").withColumn("lane", lane)
    return ops.queue_order(rows, "priority", "o_orderdate", "o_orderkey", "lane").select("lane", "o_orderkey", "priority", "place")


def job_eviction(spark, sf_dir):
    rows = _jobs(spark, sf_dir).filter("o_orderstatus = 'F'").withColumn("lane", F.col("o_custkey") % 16)
    return ops.evict_terminal(rows, "lane", "o_orderdate", "o_orderkey", 100).select("lane", "o_orderkey")


def job_listing(spark, sf_dir):
    return _jobs(spark, sf_dir).filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50).select("o_orderkey", "priority")


def _rolled(spark, sf_dir):
    return ops.telemetry(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 10, "value")


def telemetry_rollup(spark, sf_dir):
    return _rolled(spark, sf_dir).withColumns({"success_rate": F.round("success_rate", 6), "avg_duration": F.round("avg_duration", 4)})


def health_report(spark, sf_dir):
    return ops.health(_rolled(spark, sf_dir)).select("event_type", "state", "issues")


def event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value >= 10").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def latency_histogram(spark, sf_dir):
    return ops.histogram(table(spark, sf_dir, "events"), "value", "event_type")


def failure_runs(spark, sf_dir):
    return ops.failure_runs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error").select("user_id", "first", "length")


def usage_by_period(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    parts = [rows.groupBy(F.lit(p).alias("period"), F.date_trunc(p, "ts").cast("date").cast("string").alias("start"), "user_id").agg(F.count("*").alias("calls")) for p in ("day", "week", "month")]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("over_limit", F.col("calls") > 5)


def user_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def event_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_properties(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


QUERIES = {
    f.__name__: f
    for f in (
        monthly_quota, recent_calls, job_queue, job_eviction, job_listing, telemetry_rollup, health_report, event_counts,
        latency_histogram, failure_runs, usage_by_period, user_sessions, event_windows, event_properties,
    )
}

_JOBS = "(SELECT *, 6 - left(o_orderpriority, 1)::INTEGER AS priority, o_custkey % 16 AS lane FROM orders)"
_ROLL = """SELECT event_type, count(*) AS n, count(*) FILTER (value >= 10) AS n_ok, (count(*) FILTER (value >= 10)) / count(*) AS success_rate, sum(value) / count(*) AS avg_duration FROM events GROUP BY 1"""
_BINS = " UNION ALL ".join([f"SELECT event_type, '{b}' AS bound, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY 1" for b in ops.BUCKETS] + ["SELECT event_type, 'inf', count(*) FROM events GROUP BY 1"])
ORACLE_SQL = {
    "monthly_quota": f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id)::INTEGER AS used FROM events)
SELECT event_id, user_id, used, used <= {LIMIT} AS allowed, greatest({LIMIT} - used, 0)::INTEGER AS remaining, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE::VARCHAR AS resets_at FROM u""",
    "recent_calls": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events",
    "job_queue": f"SELECT lane, o_orderkey, priority, row_number() OVER (PARTITION BY lane ORDER BY priority DESC, o_orderdate, o_orderkey)::INTEGER AS place FROM {_JOBS} WHERE o_orderstatus <> 'F'",
    "job_eviction": f"SELECT lane, o_orderkey FROM {_JOBS} WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY lane ORDER BY o_orderdate DESC, o_orderkey DESC) <= 100",
    "job_listing": f"SELECT o_orderkey, priority FROM {_JOBS} WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20",
    "telemetry_rollup": f"SELECT event_type, n, n_ok, round(success_rate, 6) AS success_rate, round(avg_duration, 4) AS avg_duration FROM ({_ROLL})",
    "health_report": f"""WITH r AS ({_ROLL}), i AS (SELECT *, list_filter([CASE WHEN success_rate < 0.5 THEN 'success rate critically low' WHEN success_rate < 0.8 THEN 'success rate low' END,
  CASE WHEN avg_duration > 150 THEN 'slow responses' END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT event_type, CASE WHEN success_rate < 0.5 THEN 'unhealthy' WHEN len(l) > 0 THEN 'degraded' ELSE 'healthy' END AS state, coalesce(array_to_string(l, '; '), '') AS issues FROM i""",
    "event_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE value >= 10 GROUP BY 1",
    "latency_histogram": _BINS,
    "failure_runs": """WITH r AS (SELECT user_id, ts, event_type = 'error' AS f, row_number() OVER o - sum((event_type = 'error')::INTEGER) OVER o AS run FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(ts) AS first, count(*) AS length FROM r WHERE f GROUP BY user_id, run""",
    "usage_by_period": " UNION ALL ".join(f"SELECT '{p}' AS period, date_trunc('{p}', ts)::DATE::VARCHAR AS start, user_id, count(*) AS calls, count(*) > 5 AS over_limit FROM events GROUP BY ALL" for p in ("day", "week", "month")),
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "event_properties": "SELECT (json_extract_string(props, '$.k')::INTEGER % 10)::INTEGER AS k, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY 1",
}
