"""Sharding by extendible hashing: shards are hash prefixes, and only those that are too large take another bit.

The directory starts with one bucket. A bucket above the byte limit is split on the next hash bit, and again, until it
fits or holds a single hash value; a shard is the first bucket on a document's way that fits. Bytes are summed once by a
prefix longer than even spreading would need; all shorter prefixes are rolled up from these sums, and only documents in
buckets that still don't fit are summed again by longer ones.

What one hash value holds (rows that repeat an id and its text, or documents that collide) can't be split by bits: it
goes to a chain of overflow shards, rows of equal size together, as many in each as fit.

Defined results: null and empty texts have 0 bytes and a place like all others; null ids are hashed as empty; rows that
repeat have the same shard_id and as many chains as they need; a document above the limit, however long, has a shard of
its own; other columns pass through whatever their names; an empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.llm.common import lookup, materialise, running_offsets, salts_for

#: Hash bits; shard_id holds one more.
BITS = 60
#: Bytes of text in a shard.
LIMIT = 1 << 20
#: Bits that one pass over the oversized buckets looks ahead, and that the first pass also rolls up at once.
STEP = 6
BACK = 3


def _hash(docs: DataFrame) -> Column:
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def _rolled(sums: DataFrame, at: int, first: int, last: int) -> DataFrame:
    """(depth, p, b, lo, hi): sums by prefixes of `at` bits (p) as those of all depths from `first` to `last`."""
    every = sums.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
    every = every.withColumn("p", _shift(F.col("p"), F.lit(at) - F.col("depth")))
    return every.groupBy("depth", "p").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _directory(keys: DataFrame, total: int, limit: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """`keys` with depth, p and bytes of their shards."""
    even = min(bits, max(0, math.ceil(math.log2(max(total, 1) / limit))))
    open_, found, depth, last = keys, None, 0, min(bits, even + STEP)
    while True:
        at = _shift(F.col("h"), F.lit(bits - last))
        fine = materialise(open_.groupBy(at.alias("p")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        middle = max(depth, min(last, even) - BACK)
        sums = _rolled(fine, last, middle, last)
        if middle > depth:  # short prefixes are few, and hardly any of them fits
            short = materialise(sums.filter(F.col("depth") == middle).drop("depth"))
            sums = sums.filter(F.col("depth") > middle).unionByName(_rolled(short, middle, depth, middle))
        fits = materialise(sums.filter((F.col("b") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "p", F.col("b").alias("bytes")))
        # Of the buckets that fit only the shortest prefixes are shards: those whose parent doesn't fit.
        parent = fits.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("_up"))
        shards = fits.withColumn("_up", _shift(F.col("p"), F.lit(1))).join(parent, ["depth", "_up"], "left_anti").drop("_up")
        leaf = fine.select(F.col("p").alias("at"), F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("depth"))
        leaf = leaf.withColumn("p", _shift(F.col("at"), F.lit(last) - F.col("depth")))
        directory = materialise(leaf.join(shards, ["depth", "p"]))
        here = open_.withColumn("at", at)
        placed = here.join(directory, "at").drop("at")
        found = placed if found is None else found.unionByName(placed)
        if last == bits or not fine.join(directory, fine["p"] == directory["at"], "left_anti").limit(1).count():
            return found
        open_ = materialise(here.join(directory, "at", "left_anti").drop("at"))
        depth, last = last + 1, min(bits, last + STEP)


def shards(docs: DataFrame, limit: int = LIMIT, *carry: str) -> DataFrame:
    """(doc_id, carry..., n_bytes, shard_id, depth, chain, shard_bytes) of each row of `docs`.

    shard_id: the prefix with a 1 before it, so prefixes of all depths differ; with `chain` it names a shard. The
    directory is a table that grows with the number of shards; documents meet it by an equal-key join on its prefix.
    """
    keys = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *carry,
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            _hash(docs).alias("h"),
        )
    )
    total, n = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    found = _directory(keys, total, limit, BITS)
    shard_id = F.expr("shiftleft(1L, cast(depth AS int)) + p").alias("shard_id")
    found = found.select("doc_id", *carry, "n_bytes", "h", shard_id, F.col("depth").cast("int").alias("depth"), "bytes")

    over = F.col("bytes") > limit
    out = found.filter(~over).select("doc_id", *carry, "n_bytes", "shard_id", "depth", F.lit(0).cast("long").alias("chain"), F.col("bytes").alias("shard_bytes"))
    chained = found.filter(over)
    if chained.limit(1).isEmpty():
        return out
    rows = materialise(chained.withColumn("_chain_row", F.monotonically_increasing_id()))
    fits = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    sizes = rows.groupBy("h", "n_bytes").agg(F.count("*").alias("_n"))
    before = W.partitionBy("h").orderBy("n_bytes").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum(F.ceil(F.col("_n") / fits)).over(before), F.lit(0)))
    rows = running_offsets(rows, ["h", "n_bytes"], F.lit(1), [F.col("_chain_row")], salts_for(n), "_k")
    rows = lookup(rows, sizes, ["h", "n_bytes"], "_n", n)
    link = F.floor(F.col("_k") / fits)
    held = F.least(fits, F.col("_n") - link * fits) * F.col("n_bytes")
    return out.unionByName(
        rows.select(
            "doc_id", *carry, "n_bytes", "shard_id", "depth", (F.col("_base") + link).cast("long").alias("chain"), held.cast("long").alias("shard_bytes")
        )
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the rows of `docs` below `path`, a folder for each shard; each row goes to the shard that `shards` gives it.
    A column of `docs` that is called like one of the folders' (shard_id, chain) keeps its name and values; the folders
    take `_shard_id` and `_chain` then."""
    rows = materialise(docs.withColumn("_shard_row", F.monotonically_increasing_id()))
    taken = {c.lower() for c in docs.columns}
    names = [f"_{c}" if c in taken else c for c in ("shard_id", "chain")]
    at = shards(rows, limit, "_shard_row").select(F.col("_shard_row").alias("_at_row"), *[F.col(c).alias(f"_at_{c}") for c in ("shard_id", "chain")])
    whole = rows.join(at, F.col("_shard_row") == F.col("_at_row")).drop("_shard_row", "_at_row")
    whole = whole.withColumnsRenamed({"_at_shard_id": names[0], "_at_chain": names[1]})
    whole.repartition(*names).write.partitionBy(*names).parquet(path)


def oracle() -> str:
    """DuckDB SQL for `shards`: the first depth, from 0 on, at which a document's bucket fits."""
    return f"""
WITH k AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), {BITS // 4}))::BIGINT AS h
  FROM documents
), d AS (
  SELECT k.*, depth, h >> ({BITS} - depth) AS p FROM k, generate_series(0, {BITS}) g(depth)
), s AS (
  SELECT depth, p, sum(n_bytes)::BIGINT AS bytes FROM d GROUP BY 1, 2 HAVING sum(n_bytes) <= {LIMIT} OR min(h) = max(h)
), leaf AS (
  SELECT doc_id, n_bytes, min(depth) AS depth FROM d JOIN s USING (depth, p) GROUP BY 1, 2
)
SELECT doc_id, n_bytes, ((1::BIGINT << depth) + p)::BIGINT AS shard_id, depth::INTEGER AS depth, 0::BIGINT AS chain,
  bytes AS shard_bytes
FROM leaf JOIN d USING (doc_id, n_bytes, depth) JOIN s USING (depth, p)"""
