"""Helpers shared by the training-data operators: word splitting, scratch tables, split joins, running offsets."""

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: The six ASCII white-space characters that separate words; every other code point belongs to a word.
SPACES = " \t\n\x0b\f\r"
#: Rows that one numbering task holds, on average.
ROWS_PER_SALT = 50_000
#: Keys that `lookup` splits, at most: those with more than this part of all rows.
HOT_KEYS = 1_000
#: Rows and bytes that a slice of an Arrow batch has, about.
SLICE_ROWS, SLICE_BYTES = 64, 1 << 21


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def named(columns: list[str]) -> list[Column]:
    """Columns by name, whatever dots and backticks the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so what a Python worker makes of one at a time stays small whatever the texts are."""
    for b in batches:
        step = max(1, min(SLICE_ROWS, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: lineage ends there, so a lost executor costs no replay,
    and later plans see the true size. Files stay until `discard` or until that folder is cleaned, as with Spark's own
    checkpoints."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that no later plan reads; other DataFrames are left alone."""
    for t in tables:
        if t not in _paths:
            continue
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop(t))
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def lookup(rows: DataFrame, right: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """Inner join of `rows` with `right`, which has each key once and how many of `rows` hold it (`count`).

    A key with more than one part in HOT_KEYS of the rows is dealt over as many tasks as it has such parts, its line of
    `right` to each. No more than HOT_KEYS keys can be that frequent, so their list is small enough for every task.
    """
    part = max(1, n_rows // HOT_KEYS)
    salts = F.ceil(F.col(count) / part).cast("int")
    hot = right.filter(F.col(count) > part).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], salts.alias("_salts"))
    same = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    left = rows.join(F.broadcast(hot), same, "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int")
    left = left.withColumn("_salt", salt).drop(*[f"_hot_{k}" for k in keys], "_salts")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col(count) > part, salts - 1).otherwise(0)))
    return left.join(right.withColumn("_salt", every), [*keys, "_salt"]).drop("_salt")


def salts_for(rows: int) -> int:
    """Salts grow with the rows, so one key with any share of them still falls apart into tasks of bounded size."""
    return max(64, -(-rows // ROWS_PER_SALT))


def running_offsets(
    df: DataFrame, keys: list[str], value: Column, order: list[Column], salts: int, out: str, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same key that come before this one.

    Two levels, so a hot key isn't sorted in one task: rows are dealt by (key, hash of the order columns), numbered
    within that, and shifted by the sums of the lower salts. Order within a key: salt, then `order`, then `ties`.
    """
    salt, base, size = f"_{out}_salt", f"_{out}_base", f"_{out}_value"
    df = df.withColumn(size, value.cast("long")).withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by = [*keys, salt]
    sums = df.groupBy(*by).agg(F.sum(size).alias(base))
    before = W.partitionBy(*keys).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    within = W.partitionBy(*by).orderBy(*order, *ties).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(size).over(within), F.lit(0)))
    right = sums.select(*[F.col(k).alias(f"_r_{k}") for k in by], base)
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(salt) == F.col(f"_r_{salt}")]
    df = df.join(right, same)
    return df.withColumn(out, F.col(out) + F.col(base)).drop(*[f"_r_{k}" for k in by], base, salt, size)
