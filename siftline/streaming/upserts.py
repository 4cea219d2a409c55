"""A table kept by a stream: the newest row of each key, restartable at any point.

Rows lie in buckets by the hash of their key. A batch writes the buckets that it touches into a folder of its own and
then a manifest, a small table that names for every bucket the folder which holds it. A manifest counts once it is
written whole; readers take that of the highest batch. So a batch that was cut off left nothing behind that counts, and
is worked off again when the stream starts anew, into the same folder; one that comes again after its manifest was
written changes nothing. The cost of a batch goes with the buckets it touches.

Defined results: of rows with one key the one of the highest `order` stays, in whatever batches they come, of equal ones
that with the larger values; rows with a null in the key are left out; an empty batch writes nothing.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

BUCKETS = 16
#: Manifests that stay, with the folders they name; readers of the one before may still be at work.
KEPT = 2


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The batches whose manifests are whole, in order."""
    fs, at = _fs(spark, path)
    found = fs.globStatus(at(f"{path}/manifest-*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found)


def _named(spark: SparkSession, path: str, batch: int) -> dict[int, str]:
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string").parquet(f"{path}/manifest-{batch}").collect()}


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table as its last whole batch left it."""
    batches = _manifests(spark, path)
    folders = list(_named(spark, path, batches[-1]).values()) if batches else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(rows: DataFrame, batch: int, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Take a batch over into the table at `path`; its number makes that happen once."""
    spark = rows.sparkSession
    done = _manifests(spark, path)
    if done and done[-1] >= batch:
        return
    held = _named(spark, path, done[-1]) if done else {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = rows.dropna(subset=keys).withColumn("_bucket", bucket)
    rows = rows.groupBy("_bucket", *keys).agg(F.max(F.struct(order, F.struct(*rows.columns[:-1]).alias("_row"))).alias("_new"))
    rows = rows.persist()
    try:
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        if not touched:
            return
        new = rows.select("_bucket", "_new._row.*")
        before = [held[b] for b in touched if b in held]
        if before:
            old = spark.read.schema(new.drop("_bucket").schema).parquet(*before)
            both = new.unionByName(old.withColumn("_bucket", bucket))
            best = both.groupBy("_bucket", *keys).agg(F.max(F.struct(order, F.struct(*new.columns[1:]).alias("_row"))).alias("_new"))
            new = best.select("_bucket", "_new._row.*")
        data = f"{path}/data-{batch}"
        new.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
    finally:
        rows.unpersist()
    held |= {b: f"{data}/_bucket={b}" for b in touched}
    spark.createDataFrame(list(held.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{batch}")
    _vacuum(spark, path, done[-KEPT + 1 :] + [batch] if KEPT > 1 else [batch])


def _vacuum(spark: SparkSession, path: str, kept: list[int]) -> None:
    fs, at = _fs(spark, path)
    used = {f.rsplit("/", 1)[0].rsplit("-", 1)[1] for b in kept for f in _named(spark, path, b).values()}
    for found in fs.globStatus(at(f"{path}/*-*")):
        kind, batch = found.getPath().getName().split("-")
        if kind == "manifest" and int(batch) not in kept or kind == "data" and batch not in used:
            fs.delete(found.getPath(), True)


def upserts(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """The writer of a stream into such a table; start it again with the same folders to go on where it was."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda rows, batch: merge(rows, batch, path, keys, order, buckets))
