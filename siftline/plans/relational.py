"""Queries in the plain relational shapes: roll-ups and cubes, sliding windows, semi and set joins, approximate figures,
job tracking, snapshots and lookups."""

from pyspark.sql import Window as W, functions as F

from siftline.functions import html
from siftline.operators import extraction
from siftline.plans.extraction import SCORED_SQL, STRIP_SQL, table


def usage_rollup(spark, sf_dir):
    """Calls by type and day, with subtotals and the total."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return rows.rollup("event_type", "day").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def usage_cube(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("weekday", F.dayofweek("ts"))
    return rows.cube("event_type", "weekday").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def sliding_windows(spark, sf_dir):
    """Calls within two hours, every hour."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("start"), "event_type", "n")


def users_with_errors(spark, sf_dir):
    """Calls of users that ever had an error: a semi join, so no call counts twice."""
    events = table(spark, sf_dir, "events")
    failed = events.filter("event_type = 'error'").select("user_id")
    return events.join(failed, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


def buyers_and_signups(spark, sf_dir):
    """Users that both purchased and signed up."""
    events = table(spark, sf_dir, "events")
    return events.filter("event_type = 'purchase'").select("user_id").intersect(events.filter("event_type = 'signup'").select("user_id"))


def buyers_without_signup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.filter("event_type = 'purchase'").select("user_id").subtract(events.filter("event_type = 'signup'").select("user_id"))


def approximate_figures(spark, sf_dir):
    """Whether the sketches' distinct users are within 5 % of the exact ones, and the median within 2 % of ranks. The exact
    figures need no buffer of values: distinct users are counted by key, ranks by comparing with the sketch's median."""
    events = table(spark, sf_dir, "events")
    sketch = events.groupBy(F.col("event_type").alias("_type")).agg(F.approx_count_distinct("user_id", 0.01).alias("u"), F.percentile_approx("value", 0.5, 10_000).alias("p"))
    users = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("v"))
    ranks = events.join(sketch, F.col("event_type") == F.col("_type")).groupBy("event_type").agg(
        F.max("u").alias("u"), (F.count_if(F.col("value") < F.col("p")) / F.count("*")).alias("below"), (F.count_if(F.col("value") <= F.col("p")) / F.count("*")).alias("upto")
    )
    near = F.abs(F.col("u") - F.col("v")) <= 0.05 * F.col("v") + 1
    return ranks.join(users, "event_type").select("event_type", near.alias("users_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))


def _items(spark, sf_dir):
    """Jobs: one for each part ordered, added again by each line; attempts and state from its lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("adds"), F.max("l_quantity").alias("q"))
    attempts = (F.col("l_partkey") % 4).cast("int")
    state = F.when(F.col("l_partkey") % 5 == 0, "completed").when(attempts == 3, "failed").when(attempts > 0, "retry").otherwise("pending")
    return rows.select("l_partkey", "adds", attempts.alias("attempts"), state.alias("state"), F.col("q").cast("long").alias("seconds"))


def tracked_jobs(spark, sf_dir):
    """Order in which open jobs are taken: those to be tried again first, by attempts, then by key."""
    open_ = _items(spark, sf_dir).filter("state IN ('retry', 'pending')")
    first = F.when(F.col("state") == "retry", 0).otherwise(1)
    lane = (F.col("l_partkey") % 16).alias("lane")
    place = F.row_number().over(W.partitionBy("lane").orderBy("_f", "attempts", "l_partkey"))
    return open_.select("l_partkey", "state", "attempts", lane, first.alias("_f")).withColumn("place", place).drop("_f")


def job_progress(spark, sf_dir):
    """Counts by state, share done and the time left at the mean time of those done."""
    rows = _items(spark, sf_dir).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "retry", "pending")],
        F.avg(F.when(F.col("state") == "completed", F.col("seconds"))).alias("_mean"),
    )
    left = F.col("retry") + F.col("pending")
    return rows.select("n", "completed", "failed", "retry", "pending", F.round(F.col("completed") / F.col("n"), 6).alias("done"), F.round(left * F.col("_mean"), 3).alias("seconds_left"))


def cached_answers(spark, sf_dir):
    """Lookups in a cache whose entries live a day: the latest entry of a key before each call, if it still lives."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    before = W.partitionBy("user_id", "event_type").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last("at").over(before)
    hit = F.coalesce(F.col("at") - F.col("_last") < 86_400_000_000, F.lit(False))
    return rows.withColumn("_last", last).select("event_id", hit.alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))


def recent_events(spark, sf_dir):
    """The log's newest 100 events that parse, newest first, from lines of JSON of which some are broken."""
    line = F.when(F.col("event_id") % 10 == 3, F.lit('{"broken')).otherwise(F.to_json(F.struct("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))))
    lines = table(spark, sf_dir, "events").select(line.alias("line"))
    read = lines.select(F.from_json("line", "event_id long, event_type string, at long", {"mode": "PERMISSIVE"}).alias("e")).select("e.*").filter("event_id IS NOT NULL")
    return read.orderBy(F.desc("at"), F.desc("event_id")).limit(100)


def text_quality(spark, sf_dir):
    """Ten points for a text's length, structure, markers, density and the lack of error words, as a percentage."""
    x, n = F.col("text"), F.length("text")
    words = F.size(F.split(x, r"\s+"))
    points = (
        F.when((n > 100) & (n < 10000), 2).when(n >= 50, 1).otherwise(0)
        + (x.rlike(r"(?m)^#+ ") | x.rlike("(?i)<h[1-6]>")).cast("int")
        + (F.size(F.split(x, "\n\n")) > 2).cast("int")
        + (x.rlike("https?://") | x.rlike("(?i)<a ")).cast("int")
        + (x.rlike(r"(?m)^[-*•]\s") | x.rlike("(?i)<[uo]l>")).cast("int")
        + F.when((words > 50) & (words < 5000), 2).when(words > 20, 1).otherwise(0)
        + F.when(F.substring(x, 1, 200).rlike("(?i)error|failed|exception"), 0).otherwise(2)
    )
    return table(spark, sf_dir, "documents").select("doc_id", (points * 10).cast("long").alias("quality"))


def keyword_accuracy(spark, sf_dir):
    """Precision, recall and F1 of each page's best extraction for the six longest words of all its text, and its length.
    Nothing counts as wrongly found, so precision is 1 wherever anything is found."""
    pages = table(spark, sf_dir, "pages")
    best = extraction.select_best(extraction.score_candidates(extraction.candidates(pages))).select("page_id", "content")
    texts = pages.select("page_id", html.strip_html(F.col("html")).alias("text")).join(best, "page_id")
    lower = F.lower("text")
    words = F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z]{5,}"), F.lit(0)))
    best = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 6)
    got = F.lower("content")
    rows = texts.select("page_id", F.transform(best, lambda b: F.contains(got, b["w"])).alias("hit"), F.length("content").alias("n"))
    found = F.size(F.filter("hit", lambda h: h)) + (F.col("n") >= 200).cast("int")
    missed = F.size("hit") + 1 - found
    rows = rows.select("page_id", found.alias("tp"), missed.alias("fn"))
    precision = F.when(F.col("tp") > 0, 1.0).otherwise(0.0)
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("page_id", "tp", "fn", precision.alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def matched_metadata(spark, sf_dir):
    """Vectors whose metadata hold all wanted tags and a label: a filter over arrays, no join."""
    tags = F.array(F.concat(F.lit("l"), "label"), F.when(F.col("vec_id") % 3 == 0, "third"), F.when(F.col("vec_id") % 2 == 0, "even"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array_compact(tags).alias("tags"))
    wanted = F.array(F.lit("third"), F.lit("even"))
    return rows.filter(F.forall(wanted, lambda w: F.array_contains("tags", w)) & (F.col("label") > 2)).select("vec_id", F.array_join("tags", "|").alias("tags"))


QUERIES = {
    f.__name__: f
    for f in (
        usage_rollup, usage_cube, sliding_windows, users_with_errors, buyers_and_signups, buyers_without_signup, approximate_figures,
        tracked_jobs, job_progress, cached_answers, recent_events, text_quality, keyword_accuracy, matched_metadata,
    )
}

_ITEMS = """i AS (SELECT l_partkey, count(*) AS adds, (l_partkey % 4)::INTEGER AS attempts, CASE WHEN l_partkey % 5 = 0 THEN 'completed' WHEN l_partkey % 4 = 3 THEN 'failed' WHEN l_partkey % 4 > 0 THEN 'retry' ELSE 'pending' END AS state,
  max(l_quantity)::BIGINT AS seconds FROM lineitem GROUP BY 1)"""
ORACLE_SQL = {
    "usage_rollup": "SELECT event_type, day, count(*) AS n, grouping_id(event_type, day) AS level FROM (SELECT event_type, ts::DATE::VARCHAR AS day FROM events) GROUP BY ROLLUP (event_type, day)",
    "usage_cube": "SELECT event_type, weekday, count(*) AS n, grouping_id(event_type, weekday) AS level FROM (SELECT event_type, (dayofweek(ts) + 1)::INTEGER AS weekday FROM events) GROUP BY CUBE (event_type, weekday)",
    "sliding_windows": "SELECT start::TIMESTAMP::VARCHAR AS start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - INTERVAL (h) HOUR AS start FROM events, range(2) t(h)) GROUP BY 1, 2",
    "users_with_errors": "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1",
    "buyers_and_signups": "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'",
    "buyers_without_signup": "SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup'",
    "approximate_figures": "SELECT DISTINCT event_type, true AS users_near, true AS median_near FROM events",
    "tracked_jobs": f"WITH {_ITEMS} SELECT l_partkey, state, attempts, l_partkey % 16 AS lane, row_number() OVER (PARTITION BY l_partkey % 16 ORDER BY CASE WHEN state = 'retry' THEN 0 ELSE 1 END, attempts, l_partkey)::INTEGER AS place FROM i WHERE state IN ('retry', 'pending')",
    "job_progress": f"""WITH {_ITEMS}, c AS (SELECT count(*) AS n, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'retry') AS retry,
  count(*) FILTER (state = 'pending') AS pending, avg(seconds) FILTER (state = 'completed') AS m FROM i)
SELECT n, completed, failed, retry, pending, round(completed / n, 6) AS done, round((retry + pending) * m, 3) AS seconds_left FROM c""",
    "cached_answers": """SELECT coalesce(epoch_us(ts) - last < 86400000000, false) AS hit, count(*) AS n
FROM (SELECT ts, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS last FROM events) GROUP BY 1""",
    "recent_events": """SELECT event_id, event_type, epoch_us(ts) AS "at" FROM events WHERE event_id % 10 <> 3 ORDER BY "at" DESC, event_id DESC LIMIT 100""",
    "text_quality": r"""WITH x AS (SELECT doc_id, text, length(text) AS n, len(regexp_split_to_array(text, '\s+')) AS words FROM documents)
SELECT doc_id, (10 * (CASE WHEN n > 100 AND n < 10000 THEN 2 WHEN n >= 50 THEN 1 ELSE 0 END + (regexp_matches(text, '(?m)^#+ ') OR regexp_matches(text, '(?i)<h[1-6]>'))::INTEGER
  + (len(string_split(text, chr(10) || chr(10))) > 2)::INTEGER + (regexp_matches(text, 'https?://') OR regexp_matches(text, '(?i)<a '))::INTEGER
  + (regexp_matches(text, '(?m)^[-*•]\s') OR regexp_matches(text, '(?i)<[uo]l>'))::INTEGER + CASE WHEN words > 50 AND words < 5000 THEN 2 WHEN words > 20 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(left(text, 200), '(?i)error|failed|exception') THEN 0 ELSE 2 END))::BIGINT AS quality FROM x""",
    "keyword_accuracy": f"""WITH {SCORED_SQL}, w AS (SELECT page_id, lower(content) AS got, length(content) AS n, list_sort(list_transform(list_distinct(regexp_extract_all(lower({STRIP_SQL}), '[a-z]{{5,}}')),
  lambda x: {{'n': -length(x), 'w': x}}))[1:6] AS best FROM best JOIN (SELECT page_id, html FROM pages) USING (page_id)),
t AS (SELECT page_id, (len(list_filter(best, lambda b: contains(got, b.w))) + (n >= 200)::INTEGER)::INTEGER AS tp, len(best) AS k FROM w),
r AS (SELECT page_id, tp, (k + 1 - tp)::INTEGER AS fn, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, tp / greatest(k + 1, 1) AS rec FROM t)
SELECT page_id, tp, fn, precision, round(rec, 6) AS recall, round(CASE WHEN precision + rec > 0 THEN 2 * precision * rec / (precision + rec) ELSE 0.0 END::DOUBLE, 6) AS f1 FROM r""",
    "matched_metadata": "SELECT vec_id, 'l' || label || '|third|even' AS tags FROM embeddings WHERE vec_id % 6 = 0 AND label > 2",
}
