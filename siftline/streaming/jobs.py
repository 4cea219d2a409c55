"""Streams: telemetry windows, watches over changing content, their life cycle and admission by token bucket."""

from pyspark.sql import DataFrame, functions as F

from siftline.operators import watches
from siftline.streaming.ordered import in_order


def telemetry_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, n_errors, mean): tumbling windows on event time; rows later than the watermark are left."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = ts.groupBy(F.window("ts", width).alias("w"), "event_type")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "n_errors", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = ts.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def watch_changes(captures: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(url, ts, kind, checks, changes): each capture of a watched URL against the one before, with running counters, once
    the watermark has passed it. What is kept of a URL is one hash and two counters, and the captures that wait."""
    rows = captures.select("url", "ts", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))

    def step(state: list | None, at: int, values: tuple) -> tuple[list, list[tuple]]:
        last, checks, changes = state or (None, 0, 0)
        kind = "first" if last is None else "same" if values[0] == last else "changed"
        state = [values[0], checks + 1, changes + (kind == "changed")]
        return state, [(at, kind, *state[1:])]

    out = in_order(rows, "url", "ts", ["hash"], step, "url string, at long, kind string, checks long, changes long", late)
    return out.select("url", F.timestamp_micros("at").alias("ts"), "kind", "checks", "changes")


def watch_life(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The life of watches (operators.watches) from a stream of rows (watch_id, ts, kind, detail). A timer tells of each
    check that is due, with or without another row of its watch."""
    named = rows.withColumn("watch_id", F.col("watch_id").cast("string"))
    return in_order(named, "watch_id", "ts", ["kind", "detail"], watches.step, watches.SCHEMA, late, watches.idle)


def admission(events: DataFrame, capacity: float, per_second: float, late: str = "0 seconds") -> DataFrame:
    """(user_id, event_id, allowed): a token bucket for each user that lives on between micro-batches."""

    def step(state: list | None, at: int, values: tuple) -> tuple[list, list[tuple]]:
        tokens = capacity if state is None else min(capacity, state[0] + (at - state[1]) / 1e6 * per_second)
        ok = tokens >= 1
        return [tokens - ok, at], [(values[0], ok)]

    rows = events.select("user_id", "event_id", "ts")
    return in_order(rows, "user_id", "ts", ["event_id"], step, "user_id long, event_id long, allowed boolean", late)
