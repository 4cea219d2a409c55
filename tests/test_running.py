"""Running totals by ranges, and what is built on them, against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from siftline.functions.running import totals
from siftline.operators import changes, operations, pricing


def test_totals_of_hot_null_and_small_keys(spark):
    r = random.Random(3)
    rows = [(None if k % 5 == 0 else "hot" if k % 5 < 4 else f"k{k % 7}", r.randrange(10_000), k, r.randrange(9)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "key string, o long, id long, w long")
    got = {r["id"]: (r["n"], r["s"]) for r in totals(df, ["key"], ["o", "id"], n=F.lit(1), s=F.col("w")).collect()}
    want, n, s = {}, defaultdict(int), defaultdict(int)
    for key, _, i, w in sorted(rows, key=lambda x: (x[1], x[2])):
        want[i] = (n[key], s[key])
        n[key], s[key] = n[key] + 1, s[key] + w
    assert got == want
    assert totals(df.limit(0), ["key"], ["o"], n=F.lit(1)).collect() == []


def test_history_meets_the_version_before(spark):
    rows = [("a", k, "x" if k % 4 < 2 else None) for k in range(50)] + [(None, 1, "q"), (None, 2, "q"), ("b", 7, "z")]
    got = {(r["k"], r["v"]): r["kind"] for r in changes.history(spark.createDataFrame(rows, "k string, v long, t string"), "k", "v", "t").collect()}
    assert got[("a", 0)] == got[("b", 7)] == got[(None, 1)] == "first" and got[(None, 2)] == "same"
    assert [got[("a", k)] for k in range(1, 6)] == ["same", "changed", "same", "changed", "same"]


def test_diffs_pair_texts_by_number(spark):
    rows = [("s", 10, "a\nb"), ("s", 30, "a\nc"), ("s", 20, "a\nb"), ("t", 1, "x")]
    got = changes.diffs(spark.createDataFrame(rows, "k string, v long, t string"), "k", "v", "t").collect()
    assert sorted((r["v"], r["added"], r["removed"], r["unchanged"]) for r in got) == [(20, 0, 0, 2), (30, 1, 1, 1)]


def test_price_ranks_by_running_counts(spark):
    values = [1.0, 2.0, 2.0, 3.0, None, 10.0, 11.0]
    r = pricing.statistics(spark.createDataFrame([(v,) for v in values], "p double"), "p").first()
    assert (r["n"], r["median"], r["mode"], r["p25"], r["p75"], r["p95"]) == (6, 2.5, 2.0, 2.0, 10.0, 11.0)
    assert pricing.statistics(spark.createDataFrame([(1.0, "a"), (3.0, "a"), (5.0, None)], "p double, g string"), "p", "g").count() == 2


def test_failure_runs_and_quota(spark):
    rows = [(1, k, b) for k, b in enumerate([True, True, False, True, None, True])] + [(2, 9, False)]
    df = spark.createDataFrame(rows, "u long, id long, bad boolean").withColumn("ts", F.timestamp_seconds(F.col("id")))
    got = operations.failure_runs(df, "u", "ts", "id", F.col("bad")).collect()
    assert sorted(r["length"] for r in got) == [1, 1, 2]
    quota = operations.monthly_quota(df, "u", "ts", "id", 4).filter("u = 1").orderBy("id").collect()
    assert [(r["used"], r["allowed"], r["remaining"]) for r in quota][3:] == [(4, True, 0), (5, False, 0), (6, False, 0)]
