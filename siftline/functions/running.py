"""Running totals that no single key can overload, and where lineage is cut."""

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def checkpointing(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; only in local mode to one of our own if it is unset."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftline-")
    spark.sparkContext.setCheckpointDir(folder)


def totals(df: DataFrame, keys: list[str], order: list[str], **weights: Column) -> DataFrame:
    """`df` with a column for each weight: its sum over the rows of the same keys that come before this one.

    Rows are dealt by ranges of keys and order, so a key with any share of them is spread over many tasks: sums run
    within a range, and each range begins where those before it end. That the ranges stay what they are, the narrow
    rows are checkpointed: select what is needed before.
    """
    checkpointing(df.sparkSession)
    parts = df.withColumns({f"_w_{n}": w.cast("long") for n, w in weights.items()}).repartitionByRange(*keys, *order)
    parts = parts.withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = parts.groupBy(*keys, "_range").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights])
    ranges = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    begins = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_s_{n}").over(ranges), F.lit(0)).alias(f"_b_{n}") for n in weights]
    )
    within = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    run = parts.withColumns({f"_s_{n}": F.coalesce(F.sum(f"_w_{n}").over(within), F.lit(0)) for n in weights})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_range") == F.col("_r")]
    both = run.join(begins, same)
    return both.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(n) for n in weights])
