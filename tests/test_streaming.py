"""Streams over files, run to the end, against the same work in one batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from siftline.operators import operations, watches
from siftline.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def run(query_of, rows, tmp_path, spark, order=None, parts=3, end=None):
    """Write `rows` as `parts` files in order, stream them one file at a time, and return what came out. `end`: a row later
    than all others in a last file, which the watermark needs to pass them."""
    src, n = tmp_path / "in", rows.count()
    by = rows.orderBy(order) if order else rows
    got = by.collect()
    for k in range(parts):
        part = spark.createDataFrame(got[k * n // parts : (k + 1) * n // parts], rows.schema)
        part.coalesce(1).write.mode("append").parquet(str(src))
    if end:
        spark.createDataFrame([end], rows.schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = query_of(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_that_have_closed(spark, tmp_path):
    rows = spark.read.parquet(EVENTS)
    got = run(jobs.telemetry_windows, rows, tmp_path, spark, order="ts")
    batch = jobs.telemetry_windows(rows)
    closed = got.agg(F.max("start")).first()[0]
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(batch.filter(F.col("start") <= F.lit(closed)))
    assert got.count() > 0.8 * batch.count()


def test_watch_state_lives_on(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    rows = spark.createDataFrame([("u", day(k), x) for k, x in enumerate("aabbca")] + [("v", day(0), "q")], "url string, ts timestamp, content string")
    got = run(jobs.watch_changes, rows, tmp_path, spark, order="ts", end=("end", day(29), ""))
    kinds = [(r["kind"], r["checks"], r["changes"]) for r in got.filter("url = 'u'").orderBy("ts").collect()]
    assert kinds == [("first", 1, 0), ("same", 2, 0), ("changed", 3, 1), ("same", 4, 1), ("changed", 5, 2), ("changed", 6, 3)]


def test_admission_equals_the_batch(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).filter("user_id < 20")
    got = run(lambda s: jobs.admission(s, 2.0, 1 / 86400), rows, tmp_path, spark, order="ts", end=(-1, -1, dt.datetime(2100, 1, 1)))
    got = got.filter("user_id >= 0")
    want = operations.token_bucket(rows, "user_id", "ts", "event_id", 2.0, 1 / 86400)
    key = lambda df: sorted((r["event_id"], r["allowed"]) for r in df.collect())
    assert key(got) == key(want)


START = dt.datetime(2024, 1, 1)


def shuffled(spark, rows, schema):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), schema)


def test_many_captures_of_one_key_in_any_order(spark, tmp_path):
    """One key has 30,000 captures, spread over three files without order that arrive in batches of their own."""
    rows = [("u", START + dt.timedelta(seconds=k), str(k // 10)) for k in range(30_000)]
    got = run(jobs_late("3 days", jobs.watch_changes), shuffled(spark, rows, "url string, ts timestamp, content string"), tmp_path, spark, end=("end", dt.datetime(2100, 1, 1), ""))
    counts = {r["kind"]: r["count"] for r in got.filter("url = 'u'").groupBy("kind").count().collect()}
    assert counts == {"first": 1, "changed": 2_999, "same": 27_000}


def jobs_late(late, job):
    return lambda stream: job(stream, late=late)


def test_admission_of_one_busy_user_in_any_order(spark, tmp_path):
    rows = shuffled(spark, [(1, k, START + dt.timedelta(seconds=k)) for k in range(30_000)], "user_id long, event_id long, ts timestamp")
    got = run(lambda s: jobs.admission(s, 10.0, 0.5, "3 days"), rows, tmp_path, spark, end=(-1, -1, dt.datetime(2100, 1, 1))).filter("user_id = 1")
    want = operations.token_bucket(rows, "user_id", "ts", "event_id", 10.0, 0.5)
    assert {(r["event_id"], r["allowed"]) for r in got.collect()} == {(r["event_id"], r["allowed"]) for r in want.collect()}
    assert got.filter("allowed").count() == want.filter("allowed").count() < 16_000


LIFE = "watch_id string, ts timestamp, kind string, detail string"


def test_life_of_a_watch(spark):
    """Due after an hour without a check, not while paused or in error; told once until the next check."""
    at = lambda hours: START + dt.timedelta(hours=hours)
    rows = [
        ("w", at(0), "capture", "a"), ("w", at(0.5), "capture", "a"), ("w", at(3), "capture", "b"), ("w", at(3.2), "pause", None), ("w", at(8), "resume", None),
        ("w", at(9), "error", "timeout"), ("w", at(20), "capture", "b"), ("w", at(20.1), "every 7200", None), ("w", at(21.5), "capture", "c"), ("w", at(22), "remove", None), ("w", at(30), "note", None),
    ]
    got = watches.life_cycle(spark.createDataFrame(rows, LIFE), F.lit(at(40))).collect()
    hours = lambda micros: round((micros / 1e6 - START.replace(tzinfo=dt.timezone.utc).timestamp()) / 3600, 1)
    assert [(hours(r["at"]), r["event"], r["status"], r["checks"], r["changes"]) for r in got] == [
        (0.0, "first", "active", 1, 0), (0.5, "same", "active", 2, 0), (1.5, "due", "active", 2, 0), (3.0, "changed", "active", 3, 1), (3.2, "pause", "paused", 3, 1),
        (8.0, "resume", "active", 3, 1), (8.0, "due", "active", 3, 1), (9.0, "error", "error", 4, 1), (20.0, "same", "active", 5, 1), (20.1, "every 7200", "active", 5, 1),
        (21.5, "changed", "active", 6, 2), (22.0, "remove", "removed", 6, 2), (30.0, "note", "active", 0, 0), (30.0, "due", "active", 0, 0),
    ]


def test_streamed_lives_equal_the_batch(spark, tmp_path):
    r, rows = random.Random(3), []
    for w in range(12):
        for k in range(120):
            kind = r.choice(["capture"] * 6 + ["error", "pause", "resume", "every 600", "remove", "?"])
            rows.append((f"w{w}", START + dt.timedelta(minutes=r.randrange(5000)), kind, str(r.randrange(3))))
    df = shuffled(spark, rows, LIFE)
    got = run(jobs_late("30 days", jobs.watch_life), df, tmp_path, spark, end=("end", dt.datetime(2100, 1, 1), "remove", None)).filter("watch_id <> 'end'")
    want = watches.life_cycle(df, F.lit(dt.datetime(2100, 1, 1)))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(got) == key(want) and got.filter("event = 'due'").count() > 100
