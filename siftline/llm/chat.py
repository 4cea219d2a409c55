"""Collapse of cumulative conversation logs, then chat formatting.

Loggers often write a conversation anew after every turn. Each turn gets a rolling hash of the conversation up to it:
the exclusive-or of 128-bit hashes of (position, role, text), so it follows from the turn before. A conversation
whose last hash is an earlier hash of another one is a prefix of it; an anti-join drops it. Of equal conversations
the smallest conv_id stays. What remains is rendered.

Only whole-conversation work is per conversation (order, and rendering to one string), as one row of the result holds
a conversation anyway; copies and shared first turns are aggregated before they are shuffled.

Defined results: turns are ordered by (turn, role, text), nulls first, and count by position, whatever their numbers;
rows that repeat a turn whole count once; null roles and texts are values of their own and render as empty; each row
without conv_id is a conversation of its one turn, so any number of them is dealt as any other rows; very long turns are hashed and rendered whole; an empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from pyspark.sql import DataFrame, Window as W, functions as F


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of each conversation that no other one continues."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    alone = rows.filter("conv_id IS NULL").select("role", "text")
    rows = rows.filter("conv_id IS NOT NULL")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    here = F.struct("turn", "role", "text")
    rows = rows.withColumn("_again", F.coalesce(F.lag(here).over(order) == here, F.lit(False))).filter("NOT _again")
    rows = rows.withColumn("pos", F.row_number().over(order))
    said = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    up_to = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(
        "conv_id",
        "pos",
        "role",
        "text",
        F.bit_xor(F.xxhash64(F.lit(1), *said)).over(up_to).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), *said)).over(up_to).alias("h2"),
        F.count("*").over(W.partitionBy("conv_id")).alias("n_turns"),
    )
    whole = rows.filter(F.col("pos") == F.col("n_turns")).groupBy("h1", "h2", "n_turns")
    whole = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    single = [F.lit(1).alias("pos"), F.col("role"), F.col("text")]
    said = [F.lit(1), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    alone = alone.select(F.xxhash64(F.lit(1), *said).alias("h1"), F.xxhash64(F.lit(2), *said).alias("h2"), *single)
    copies = alone.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first(F.struct("pos", "role", "text")).alias("turn"))
    copies = copies.withColumn("n_turns", F.lit(1).cast("long"))
    whole = whole.join(copies, ["h1", "h2", "n_turns"], "full")
    whole = whole.withColumn("n_copies", F.coalesce("n_copies", F.lit(0)) + F.coalesce("n", F.lit(0)))
    begun = rows.filter(F.col("pos") < F.col("n_turns")).select("h1", "h2", F.col("pos").alias("n_turns")).distinct()
    kept = whole.join(begun, ["h1", "h2", "n_turns"], "left_anti").select(F.col("conv_id").alias("_id"), "n_copies", "n_turns", "turn")
    said = rows.join(kept.drop("n_turns", "turn"), F.col("conv_id") == F.col("_id"))
    turns_ = F.array_sort(F.collect_list(F.struct("pos", "role", "text")))
    done = said.groupBy("conv_id", "n_turns", "n_copies").agg(turns_.alias("turns"))
    rest = kept.filter("_id IS NULL").select(F.col("_id").alias("conv_id"), "n_turns", "n_copies", F.array("turn").alias("turns"))
    return done.union(rest).select("conv_id", "n_turns", "n_copies", render("turns").alias("text"))


def render(turns: str):
    """ChatML-like text of an array of (role, text)."""
    one = F.transform(
        turns,
        lambda t: F.concat(
            F.lit("<|im_start|>"),
            F.coalesce(t["role"], F.lit("")),
            F.lit("\n"),
            F.coalesce(t["text"], F.lit("")),
            F.lit("<|im_end|>\n"),
        ),
    )
    return F.array_join(one, "")


def oracle() -> str:
    """DuckDB SQL that compares whole turn lists."""
    return r"""
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM t GROUP BY conv_id, alone
), one AS (
  SELECT min(conv_id) AS conv_id, l, count(*) AS n_copies FROM c GROUP BY l
)
SELECT conv_id, len(l)::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
  array_to_string(list_transform(l, lambda t: '<|im_start|>' || coalesce(t.r, '') || chr(10) || coalesce(t.x, '')
    || '<|im_end|>' || chr(10)), '') AS text
FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE len(b.l) > len(a.l) AND list_slice(b.l, 1, len(a.l)) = a.l)"""
