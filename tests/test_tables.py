"""Tables kept by streams, table functions and stored sketches."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import table_functions
from siftline.operators import sketches
from siftline.streaming import upserts

SCHEMA = "k string, at long, v string"


def newest(rows):
    out = {}
    for k, at, v in rows:
        if k is not None:
            out[k] = max(out.get(k, (at, v)), (at, v))
    return {k: v for k, v in out.items()}


def held(spark, path):
    rows = upserts.read(spark, path, SCHEMA).collect()
    assert len({r["k"] for r in rows}) == len(rows)
    return {r["k"]: (r["at"], r["v"]) for r in rows}


def test_batches_in_any_order_and_again(spark, tmp_path):
    r, path, done = random.Random(1), str(tmp_path / "t"), []
    for batch in range(5):
        rows = [(r.choice(["a", "b", "c", None, f"x{r.randrange(40)}"]), r.randrange(100), str(r.randrange(9))) for _ in range(60)]
        upserts.merge(spark.createDataFrame(rows, SCHEMA), batch, path, ["k"], "at", buckets=4)
        done += rows
        assert held(spark, path) == newest(done)
        upserts.merge(spark.createDataFrame([("a", 10**6, "again")], SCHEMA), batch, path, ["k"], "at", buckets=4)
        assert held(spark, path) == newest(done)
    upserts.merge(spark.createDataFrame([], SCHEMA), 9, path, ["k"], "at", buckets=4)
    assert held(spark, path) == newest(done)
    assert upserts.read(spark, str(tmp_path / "none"), SCHEMA).count() == 0


@pytest.mark.parametrize("killed_at", ["data", "manifest"])
def test_a_stream_killed_in_a_batch_goes_on_where_it_was(spark, tmp_path, monkeypatch, killed_at):
    r = random.Random(2)
    files = [[(f"k{r.randrange(30)}", r.randrange(1000), str(n)) for _ in range(40)] for n in range(4)]
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, state = str(tmp_path / "t"), str(tmp_path / "state")

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = upserts.upserts(stream, path, ["k"], "at", state, buckets=4).trigger(availableNow=True).start()
        q.awaitTermination()

    merge, calls = upserts.merge, []

    def killed(rows, batch, *more):
        """The third batch ends before its data is written, or before anyone learns that its manifest was."""
        calls.append(batch)
        if len(calls) == 3 and killed_at == "data":
            raise RuntimeError("killed")
        merge(rows, batch, *more)
        if len(calls) == 3:
            raise RuntimeError("killed")

    monkeypatch.setattr(upserts, "merge", killed)
    with pytest.raises(Exception, match="killed"):
        start()
    start()
    assert calls == [0, 1, 2, 2, 3]
    assert held(spark, path) == newest(x for f in files for x in f)


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    page = "<h1>A <i>b</i></h1><ul><li>x <a href='/y'>z</a></ul><table><tr><td>1<td>2<table><tr><td>in</table><tr><th>3</table>"
    spark.createDataFrame([(1, page), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    nodes = spark.sql("SELECT id, n.* FROM some_pages p, LATERAL sift_nodes(p.html) n ORDER BY node_no").collect()
    assert [tuple(x) for x in nodes] == [(1, 0, "h1", "A b"), (1, 1, "li", "x z (link: /y)")]
    cells = spark.sql("SELECT c.* FROM some_pages p, LATERAL sift_cells(p.html) c ORDER BY table_no, row_no, cell_no").collect()
    assert [tuple(x) for x in cells] == [(0, 0, 0, "1"), (0, 0, 1, "2in"), (0, 1, 0, "3"), (1, 0, 0, "in")]
    spark.createDataFrame([("s", 3, "b"), ("s", 1, "a"), ("s", 2, "a"), ("t", 1, None), ("t", 2, "")], "k string, n long, x string").createOrReplaceTempView("some_versions")
    got = spark.sql("SELECT * FROM sift_history(TABLE(some_versions) PARTITION BY k ORDER BY n) ORDER BY key, place").collect()
    assert [tuple(x) for x in got] == [("s", 1, 1, "first"), ("s", 2, 2, "same"), ("s", 3, 3, "changed"), ("t", 1, 1, "first"), ("t", 2, 2, "same")]


def test_merged_sketches_stay_near_exact_figures(spark, tmp_path):
    rows = spark.range(60_000).select(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") % 7919).alias("user"), ((F.col("id") * 7919) % 60_000).cast("double").alias("v"), F.lit("a").alias("g"))
    sketches.hourly(rows, "ts", ["g"], "user", "v").write.parquet(str(tmp_path / "s"))
    hours = spark.read.parquet(str(tmp_path / "s"))
    assert hours.count() >= 1000
    got = sketches.rolled_up(hours.withColumn("hour", F.lit("2024-01-01").cast("timestamp")), "year", ["g"]).first()
    assert got["n"] == 60_000 and abs(got["n_distinct"] - 7919) < 0.05 * 7919
    assert abs(got["p50"] - 30_000) < 0.03 * 60_000 and abs(got["p95"] - 57_000) < 0.03 * 60_000
