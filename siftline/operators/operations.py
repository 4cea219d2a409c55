"""Quotas, job queues, telemetry, health, metrics and failure runs over event tables."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.functions.running import totals
from siftline.operators.admission import circuit_breaker, token_bucket  # noqa: F401

#: Upper bounds of the latency histogram.
BUCKETS = (25, 50, 100, 150, 200, 300, 500)


def monthly_quota(events: DataFrame, tenant: str, ts: str, order: str, limit: int) -> DataFrame:
    """Each call's number within its tenant's UTC month, what remains after it, when the month resets, and `allowed`."""
    month = F.date_trunc("month", F.col(ts))
    out = totals(events.select(tenant, ts, order, month.alias("_month")), [tenant, "_month"], [ts, order], used=F.lit(1))
    out = out.withColumn("used", (F.col("used") + 1).cast("int"))
    return out.withColumns(
        {
            "allowed": F.col("used") <= limit,
            "remaining": F.greatest(F.lit(limit) - F.col("used"), F.lit(0)),
            "resets_at": F.add_months("_month", 1).cast("date"),
        }
    ).drop("_month")


def calls_in_window(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """`recent`: calls of the same key in the `seconds` up to each call, itself included.

    Calls are dealt by key and stretch of time, each stretch with the one before it beside it, so no key is one window.
    Calls without a time have those without one beside them.
    """
    width = seconds * 1_000_000
    rows = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_own", F.floor(F.col("_at") / width))
    beside = F.when(F.col("_own").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array("_own", F.col("_own") + 1))
    rows = rows.withColumn("_in", F.explode(beside))
    frame = W.partitionBy(key, "_in").orderBy("_at").rangeBetween(-width, 0)
    counted = rows.withColumn("recent", F.count("*").over(frame)).filter(F.col("_in").eqNullSafe(F.col("_own")))
    return counted.drop("_at", "_own", "_in")


def queue_order(jobs: DataFrame, priority: str, created: str, key: str, lanes: str) -> DataFrame:
    """`place`: order of execution within a lane, highest priority first, then oldest."""
    rows = totals(jobs.withColumn("_first", -F.col(priority)), [lanes], ["_first", created, key], place=F.lit(1))
    return rows.withColumn("place", (F.col("place") + 1).cast("int")).drop("_first")


def evict_terminal(jobs: DataFrame, lanes: str, completed: str, key: str, keep: int) -> DataFrame:
    """Only the `keep` jobs of a lane that completed last stay."""
    order = W.partitionBy(lanes).orderBy(F.desc(completed), F.desc(key))
    return jobs.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= keep).drop("_k")


def telemetry(events: DataFrame, by: str, ok: Column, value: str) -> DataFrame:
    """Success rate, mean duration over all calls, and counts, for each group: one aggregation with partial sums."""
    return events.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_ok"),
        (F.count_if(ok) / F.count("*")).alias("success_rate"),
        (F.sum(value) / F.count("*")).alias("avg_duration"),
    )


def health(rolled: DataFrame) -> DataFrame:
    """healthy, degraded or unhealthy with the issues found."""
    issues = F.array_compact(
        F.array(
            F.when(F.col("success_rate") < 0.5, "success rate critically low").when(F.col("success_rate") < 0.8, "success rate low"),
            F.when(F.col("avg_duration") > 150, "slow responses"),
        )
    )
    state = F.when(F.col("success_rate") < 0.5, "unhealthy").when(F.size(issues) > 0, "degraded").otherwise("healthy")
    return rolled.withColumns({"state": state, "issues": F.array_join(issues, "; ")})


def histogram(events: DataFrame, value: str, by: str) -> DataFrame:
    """(by, bound, n): how many values are at most each bound, cumulative, the last bound open."""
    rows = events.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(str(b)) for b in BUCKETS], F.count("*").alias("inf"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("bound"), F.col(str(b)).alias("n")) for b in (*BUCKETS, "inf")])
    return rows.select(by, F.inline(pairs))


def failure_runs(events: DataFrame, key: str, ts: str, order: str, failed: Column) -> DataFrame:
    """(key, first, last, length) of each run of consecutive failures (gaps and islands)."""
    rows = events.select(key, ts, order, F.coalesce(failed, F.lit(False)).alias("_f"))
    # As many calls that didn't fail lie before each failure of a run, and more before the next run.
    runs = totals(rows, [key], [ts, order], _run=(~F.col("_f")).cast("int")).filter("_f").groupBy(key, "_run")
    return runs.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("length")).drop("_run")
