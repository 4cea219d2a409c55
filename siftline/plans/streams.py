"""Queries that run as streams: each reads its table as a stream of files, works it off and gives what the sink holds.

Results go through a Parquet sink in the shared folder, never through the driver.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators import watches
from siftline.plans.admission import _CALLS, CAPACITY, DAY
from siftline.plans.extraction import table
from siftline.streaming import jobs

#: The row that ends a stream.
END, END_KEY = "2200-01-01 00:00:00", "\x00end"


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftline-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream; as a pattern, the path may be that of a folder or of a single file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _ended(rows: DataFrame, **end) -> DataFrame:
    """A stream with one more row, later than all others, after which the watermark has passed these."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession)
    values = [F.lit(end.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*values).write.parquet(folder)
    return rows.union(spark.readStream.schema(rows.schema).parquet(folder))


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has written once it has read all there is. In complete mode each batch replaces the last."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    else:
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def streamed_windows(spark, sf_dir):
    """Hourly counts by type as the stream has them at its end."""
    out = _drained(jobs.telemetry_windows(_read(spark, sf_dir, "events")), "complete")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", "n_errors", F.round("mean", 4).alias("mean"))


def streamed_sessions(spark, sf_dir):
    out = _drained(jobs.sessions(_read(spark, sf_dir, "events")), "complete")
    return out.select("user_id", F.col("start").cast("string").alias("start"), "n")


def streamed_watches(spark, sf_dir):
    """Documents of one source as captures of one watched address, in order of their ids."""
    docs = _read(spark, sf_dir, "documents")
    captures = docs.select(F.col("source").alias("url"), F.timestamp_seconds(F.col("doc_id") + 1).alias("ts"), F.col("text").alias("content"))
    out = _drained(jobs.watch_changes(_ended(captures, url=END_KEY, ts=END)), "append").filter(F.col("url") != END_KEY)
    return out.groupBy("url").agg(F.max("checks").alias("checks"), F.max("changes").alias("changes"))


def streamed_admission(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = _drained(jobs.admission(_ended(events, user_id=-1, event_id=-1, ts=END), CAPACITY, 1 / DAY), "append")
    return out.filter("user_id >= 0").select("user_id", "event_id", "allowed")


def _watched(events: DataFrame) -> DataFrame:
    """Each user's events as what happened to a watch of theirs: a check every day, most events captures."""
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "pause").when(F.col("event_type") == "signup", "resume")
    kind = F.when(F.col("event_id") % 11 == 0, "every 86400").otherwise(kind.otherwise("capture"))
    rows = events.select(F.col("user_id").cast("string").alias("watch_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"))
    return rows.select("watch_id", "ts", "kind", F.floor(F.col("event_id") / 3).cast("string").alias("detail"))


def _told(rows: DataFrame) -> DataFrame:
    """What each watch's life came to."""
    last = F.max_by("status", F.struct("at", F.col("event") == "due", "checks"))
    return rows.groupBy("watch_id").agg(
        F.max("checks").alias("checks"), F.max("changes").alias("changes"), F.count_if(F.col("event") == "due").alias("dues"), F.sum("at").alias("sum_at"), last.alias("status")
    )


def watch_life(spark, sf_dir):
    return _told(watches.life_cycle(_watched(table(spark, sf_dir, "events")), F.lit(END).cast("timestamp")))


def streamed_watch_life(spark, sf_dir):
    rows = _ended(_watched(_read(spark, sf_dir, "events")), watch_id=END_KEY, ts=END, kind="remove")
    return _told(_drained(jobs.watch_life(rows), "append").filter(F.col("watch_id") != END_KEY))


QUERIES = {f.__name__: f for f in (streamed_windows, streamed_sessions, streamed_watches, streamed_admission, watch_life, streamed_watch_life)}
_LIFE = f"""WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS w, epoch_us(ts) AS t, CASE WHEN event_id % 11 = 0 THEN 'every 86400' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'pause'
    WHEN event_type = 'signup' THEN 'resume' ELSE 'capture' END AS kind, (event_id // 3)::VARCHAR AS detail FROM events
), o AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY t, kind, detail) AS k FROM e
), f AS (
  SELECT w, 0::BIGINT AS k, 'active' AS status, {watches.INTERVAL}::BIGINT AS every, t AS last, NULL::BIGINT AS checked, NULL::VARCHAR AS held, 0::BIGINT AS checks, 0::BIGINT AS changes,
    true AS told, 0::BIGINT AS dues, 0::HUGEINT AS sum_at FROM o WHERE k = 1
  UNION ALL
  SELECT w, k, CASE WHEN kind = 'capture' AND status = 'error' OR kind = 'resume' THEN 'active' WHEN kind = 'error' THEN 'error' WHEN kind = 'pause' THEN 'paused' ELSE status END,
    CASE WHEN kind = 'every 86400' THEN 86400 ELSE every END, t, CASE WHEN kind IN ('capture', 'error') THEN t ELSE checked END, CASE WHEN kind = 'capture' THEN detail ELSE held END,
    checks + CASE WHEN kind IN ('capture', 'error') THEN 1 ELSE 0 END, changes + CASE WHEN kind = 'capture' AND held <> detail THEN 1 ELSE 0 END,
    CASE WHEN kind IN ('capture', 'error', 'every 86400') THEN false ELSE told OR now END, dues + now::INTEGER, sum_at + t + CASE WHEN now THEN due ELSE 0 END
  FROM (SELECT *, coalesce(status = 'active' AND NOT told AND due <= t, false) AS now
    FROM (SELECT o.*, f.status, f.every, f.checked, f.held, f.checks, f.changes, f.told AND o.k > 1 AS told, f.dues, f.sum_at, CASE WHEN o.k = 1 THEN NULL ELSE greatest(f.last, coalesce(f.checked + f.every * 1000000, f.last)) END AS due
      FROM f JOIN o ON o.w = f.w AND o.k = f.k + 1))
), z AS (
  SELECT *, status = 'active' AND NOT told AS more FROM f QUALIFY row_number() OVER (PARTITION BY w ORDER BY k DESC) = 1
)
SELECT w AS watch_id, checks, changes, (dues + more::INTEGER)::BIGINT AS dues, (sum_at + CASE WHEN more THEN greatest(last, coalesce(checked + every * 1000000, last)) ELSE 0 END)::BIGINT AS sum_at, status FROM z"""
ORACLE_SQL = {
    "watch_life": _LIFE,
    "streamed_watch_life": _LIFE,
    "streamed_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP::VARCHAR AS start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2",
    "streamed_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "streamed_watches": """WITH p AS (SELECT source, sha256(coalesce(text, '')) AS h, lag(sha256(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents)
SELECT source AS url, count(*) AS checks, count(*) FILTER (before <> h) AS changes FROM p GROUP BY 1""",
    "streamed_admission": f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT user_id, event_id, k, tm, {CAPACITY}::DOUBLE - 1 AS tokens, true AS ok FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, tm, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1
  FROM (SELECT e.user_id, e.event_id, e.k, e.tm, least({CAPACITY}::DOUBLE, f.tokens + (e.tm - f.tm) / 1000000::DOUBLE * (1 / {DAY}::DOUBLE)) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
) SELECT user_id, event_id, ok AS allowed FROM f""",
}
