"""Queries on table functions in SQL text, stored sketches, a table kept by a stream, and files written and read back."""

from pyspark.sql import functions as F

from siftline.functions import table_functions
from siftline.operators import sketches
from siftline.plans.changes import _HIST
from siftline.plans.extraction import NODE_SQL, dealt, table
from siftline.plans.streams import _folder, _read
from siftline.sources import exports
from siftline.streaming import upserts

#: Relative error of distinct counts and error of a quantile's rank that the stored sketches stay within.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.03


def lateral_nodes(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql("SELECT p.page_id, n.node_no, n.tag, n.text FROM {pages} p, LATERAL sift_nodes(p.html) n", pages=table(spark, sf_dir, "pages"))


def lateral_cells(spark, sf_dir):
    """Cells of the tables in pages, read in SQL: a table for each 400 parts."""
    table_functions.register(spark)
    row = F.concat(F.lit("<tr><td>"), "p_partkey", F.lit("<td><b> "), "p_name", F.lit("</b></tr>"))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 400).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    pages = pages.select(F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("html"))
    return spark.sql(
        """SELECT CAST(max(CASE WHEN cell_no = 0 THEN text END) AS BIGINT) AS p_partkey, max(CASE WHEN cell_no = 1 THEN text END) AS name
           FROM (SELECT uuid() AS page, html FROM {pages}) p, LATERAL sift_cells(p.html) GROUP BY page, row_no""",
        pages=pages,
    )


def partitioned_history(spark, sf_dir):
    """Versions of each source's documents, by a table function that sees each source's rows in order."""
    table_functions.register(spark)
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    rows = spark.sql("SELECT * FROM sift_history(TABLE(SELECT source, doc_id, text FROM {docs}) PARTITION BY source ORDER BY doc_id)", docs=docs)
    return rows.select(F.col("key").alias("source"), F.col("place").alias("doc_id"), "version", "kind")


def stored_sketches(spark, sf_dir):
    """Days from hourly sketches, written and read back, and whether they are as near the rows' own figures as promised."""
    events = table(spark, sf_dir, "events")
    path = _folder(spark)
    sketches.hourly(events, "ts", ["event_type"], "user_id", "value").write.parquet(path)
    days = sketches.rolled_up(spark.read.parquet(path), "day", ["event_type"])
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("span")
    exact = events.select(day, "event_type", "user_id", F.col("value").cast("double").alias("value")).join(days, ["span", "event_type"]).groupBy("span", "event_type")
    exact = exact.agg(
        F.first("n").alias("n"), F.countDistinct("user_id").alias("users"), F.first("n_distinct").alias("n_distinct"), F.count("value").alias("values"),
        *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_at") for p in ("p50", "p95")], *[F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")],
    )

    def near(p: str, q: float):
        # The quantile's ranks, from the first to the last row of that value, reach the one asked for within the error.
        slack = F.col("values") * RANK_ERROR + 1
        return (F.col(f"{p}_below") - slack <= F.col("values") * q) & (F.col(f"{p}_at") + slack >= F.col("values") * q)

    users_near = F.abs(F.col("n_distinct") - F.col("users")) <= F.col("users") * DISTINCT_ERROR + 1
    return exact.select(F.col("span").cast("string").alias("day"), "event_type", "n", users_near.alias("users_near"), near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"))


def streamed_upserts(spark, sf_dir):
    """The last order of each customer, kept by a stream of orders."""
    folder = _folder(spark)
    stream = _read(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_totalprice")
    upserts.upserts(stream, f"{folder}/table", ["o_custkey"], "at", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = upserts.read(spark, f"{folder}/table", stream.schema)
    return rows.select("o_custkey", F.col("at.o_orderkey").alias("o_orderkey"), F.round("o_totalprice", 2).alias("o_totalprice"))


def mailed_suppliers(spark, sf_dir):
    """A mail for each supplier, written as a file of its own and read back."""
    folder, line = _folder(spark), "\r\n"
    mail = F.concat_ws(
        line, F.concat(F.lit("from: "), "s_name", F.lit(" <s@x.example>")), F.lit("To: me@x.example"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("Subject:  Account of "), "s_suppkey", F.lit("  "))),
        F.lit("Date: Mon, 1 Jan 2024 00:00:00 +0000"), F.lit(""), F.concat(F.lit("Dear "), "s_name", F.lit(",")), F.lit(""), F.lit("Subject: not this one"),
    )
    exports.write_emails(dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(mail.alias("value")), folder)
    rows = exports.emails(spark, folder)
    return rows.select(F.regexp_extract("sender", r"^(.*) <", 1).alias("s_name"), "recipient", "subject", "sent", F.rtrim("body", F.lit("\n")).alias("body"))


def listed_urls(spark, sf_dir):
    """Addresses of pages as a list with remarks and blank lines, read back."""
    folder, k = _folder(spark), F.col("page_id")
    lines = F.array(F.when(k % 3 == 0, F.concat(F.lit("# page "), k)).otherwise(""), F.concat(F.lit("  "), "url", F.when(k % 2 == 0, "  ").otherwise("")))
    table(spark, sf_dir, "pages").select(F.explode(lines).alias("value")).write.text(folder)
    return exports.url_list(spark, folder)


def telemetry_files(spark, sf_dir):
    """Events appended as lines of JSON below a folder for each day, and read back by day and type."""
    folder = _folder(spark)
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    events.select("day", F.to_json(F.struct("event_id", "event_type", F.col("value").cast("double").alias("value"))).alias("value")).write.partitionBy("day").text(folder)
    rows = spark.read.schema("event_id long, event_type string, value double, day string").json(folder)
    # Rounded as the SQL does it: the double's multiple, not the decimal number it is written as.
    mean = F.round(F.avg("value") * 10_000) / 10_000
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), mean.alias("mean"))


QUERIES = {f.__name__: f for f in (lateral_nodes, lateral_cells, partitioned_history, stored_sketches, streamed_upserts, mailed_suppliers, listed_urls, telemetry_files)}
ORACLE_SQL = {
    "mailed_suppliers": """SELECT s_name, 'me@x.example' AS recipient, CASE WHEN s_suppkey % 3 > 0 THEN 'Account of ' || s_suppkey END AS subject, 'Mon, 1 Jan 2024 00:00:00 +0000' AS sent,
  'Dear ' || s_name || ',' || chr(10) || chr(10) || 'Subject: not this one' AS body FROM supplier""",
    "listed_urls": "SELECT url FROM pages",
    "telemetry_files": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(avg(value::DOUBLE), 4) AS mean FROM events GROUP BY 1, 2",
    "lateral_nodes": rf"WITH {NODE_SQL}, g AS (SELECT page_id, node_no, lower(regexp_extract(x, '^<([a-z0-9]+)', 1, 'i')) AS tag FROM node0) SELECT page_id, node_no, tag, text FROM node JOIN g USING (page_id, node_no) WHERE length(text) > 0",
    "lateral_cells": "SELECT p_partkey, p_name AS name FROM part",
    "partitioned_history": f"{_HIST} SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS version, kind FROM k",
    "stored_sketches": "SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS day, event_type, count(*) AS n, true AS users_near, true AS p50_near, true AS p95_near FROM events GROUP BY 1, 2",
    "streamed_upserts": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2) AS o_totalprice FROM orders GROUP BY 1",
}
