"""Price statistics, deals, trends and how sure an analysis is."""

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.running import totals

PERCENTILES = (25, 50, 75, 90, 95)


def statistics(rows: DataFrame, price: str, *by: str) -> DataFrame:
    """Counts, means, mode, median and nearest-rank percentiles of each group.

    mode: the smallest of the most frequent prices, null where no price repeats. Prices are counted first; ranks come
    from running totals of these counts by ranges of prices, so no group is held or sorted in one task.
    """
    keys = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    counted = rows.filter(F.col(price).isNotNull()).groupBy(*keys, F.col(price).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    placed = totals(counted, keys, ["_x"], _before=F.col("_n"))
    stats = rows.groupBy(*keys).agg(
        F.count(price).alias("n"),
        F.avg(price).alias("mean"),
        F.min(price).alias("min"),
        F.max(price).alias("max"),
        F.stddev_pop(price).alias("std_dev"),
        F.var_pop(price).alias("variance"),
        (F.max(price) - F.min(price)).alias("range"),
    )
    size = stats.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("n").alias("_total"))
    placed = placed.join(size, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])

    def at(place: Column) -> Column:
        """The value at a place counted from 0."""
        return F.min(F.when(F.col("_before") + F.col("_n") > place, F.col("_x")))

    total = F.col("_total")
    ranks = {f"p{p}": at(F.ceil(F.lit(p) * total / 100) - 1) for p in PERCENTILES}
    top = F.max(F.struct("_n", (-F.col("_x")).alias("_x")))
    ranked = placed.groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg(
        ((at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2).alias("median"),
        *[c.alias(n) for n, c in ranks.items()],
        F.when(top["_n"] > 1, -top["_x"]).alias("mode"),
    )
    out = stats.join(ranked, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left")
    return out.select(*by, "n", "mean", "median", "min", "max", "std_dev", "variance", "range", *ranks, "mode")


def deals(rows: DataFrame, price: str, key: str, condition: str, top: int = 10) -> DataFrame:
    """The `top` rows furthest below 85 % of the mean, with the reasons. The one-row statistics are joined to the scan."""
    x = F.col(price)
    stats = statistics(rows, price).select(F.col("mean").alias("_mean"), F.col("p25").alias("_p25"))
    found = rows.crossJoin(F.broadcast(stats)).filter(x < F.col("_mean") * 0.85)
    saved = (F.col("_mean") - x) / F.col("_mean") * 100
    tenths = F.floor(saved * 10 + 0.5).cast("long")
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("% below average"))
    why = F.concat(
        text,
        F.when(x < F.col("_p25"), " (bottom 25%)").otherwise(""),
        F.when(F.col(condition) == "new", " + NEW condition!").otherwise(""),
    )
    out = found.select(key, x.alias("price"), saved.alias("savings_percent"), why.alias("reason"))
    return out.orderBy(F.desc("savings_percent"), key).limit(top)


def trends(rows: DataFrame, price: str, sold: str, as_of: Column, days: int) -> DataFrame:
    """The mean of the later half of `days` before `as_of` against the earlier half; null below ten dated rows."""
    age = (as_of.cast("double") - F.col(sold).cast("timestamp").cast("double")) / 86400
    late, early = age <= days / 2, (age > days / 2) & (age <= days)
    got = rows.filter(F.col(sold).isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(F.when(late, F.col(price))).alias("recent_avg"),
        F.avg(F.when(early, F.col(price))).alias("older_avg"),
    )
    change = (F.col("recent_avg") - F.col("older_avg")) / F.col("older_avg") * 100
    got = got.filter("n >= 10 AND recent_avg IS NOT NULL AND older_avg IS NOT NULL").withColumn("change_percent", change)
    way = F.when(F.col("change_percent") > 5, "up").when(F.col("change_percent") < -5, "down").otherwise("stable")
    return got.withColumn("direction", way)


def confidence(rows: DataFrame, price: str, dated: Column, known: Column, *by: str) -> DataFrame:
    """Band of the sample's size, shares of dated rows and known conditions, and a bonus for an even market."""
    got = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(dated.cast("int")).alias("_d"),
        F.avg(known.cast("int")).alias("_k"),
        (F.stddev_pop(price) / F.avg(price)).alias("cv"),
    )
    size = F.when(F.col("n") >= 50, 0.4).when(F.col("n") >= 20, 0.3).when(F.col("n") >= 10, 0.2).otherwise(0.1)
    even = F.when(F.col("cv") < 0.2, 0.1).when(F.col("cv") < 0.4, 0.05).otherwise(0.0)
    return got.select(*by, "n", "cv", F.least(size + F.col("_d") * 0.3 + F.col("_k") * 0.2 + even, F.lit(1.0)).alias("confidence"))


def upper_median(rows: DataFrame, price: str, *by: str) -> DataFrame:
    """Low, upper median, high and mean: the upper median is the value at place floor(n / 2) counted from 0.

    Values are counted, and numbered over ranges of group and value, so no group is gathered in one task. The mean's sum is decimal (six
    places): it doesn't depend on the order of rows.
    """
    counted = rows.groupBy(*by, F.col(price).alias("_x")).agg(F.count("*").alias("_n"))
    placed = totals(counted, [*by], ["_x"], _before=F.col("_n"))
    whole = placed.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.min("_x").alias("low"),
        F.max("_x").alias("high"),
        (F.sum(F.col("_x").cast("decimal(18,6)") * F.col("_n")).cast("double") / F.sum("_n")).alias("average"),
    )
    ends = whole.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("n").alias("_total"))
    at = placed.join(ends, functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by), F.lit(True)))
    upper = F.when(F.col("_before") + F.col("_n") > F.floor(F.col("_total") / 2), F.col("_x"))
    middle = at.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.min(upper).alias("median"))
    both = whole.join(middle, functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by), F.lit(True)))
    return both.select(*by, "n", "low", "median", "high", "average")
