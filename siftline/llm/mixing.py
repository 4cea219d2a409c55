"""Mixing sources to target weights by fixed-length blocks.

The words of each source, its documents laid end to end, are cut into blocks of `block` words. The output is a number
of shards; each draws from a multinomial how many of its slots each source fills, with what each source has still to
give as probabilities, so shards vary but the totals are met. A source's slots are numbered through; slot j takes
block permutation(j mod blocks) of its epoch j div blocks, a keyed Feistel permutation of the source's block numbers,
so a source is used up before any block comes again. Slots and blocks are joined by (source, block).

Defined results: null and empty texts have size 0 and give nothing; a null source is a source, ordered last; each row
is a document of its own, so repeated ids or rows are mixed as often as they occur; null ids pass through; rows that tie
in id and text are alike, so which comes first changes nothing; very long texts are cut into blocks like all others, one
text at a time; other columns pass through whatever their names; an empty table gives no rows. The driver holds one row
for each source, and one for each source and shard.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import materialise, named, running_offsets, salts_for, slices, word_count
from siftline.llm.neardup import mix as spread

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Words of a block.
BLOCK = 64
#: Output shards at least; as the output grows, a shard has this many slots at most.
SHARDS, SHARD_SLOTS = 64, 1 << 24
SEED = 7
#: Slots that one row of the slot plan stands for, at most, before it is unfolded; tasks unfold about eight rows each.
_CHUNK = 1 << 16


def targets(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Shares of the total by weight; what exceeds `cap` times a source's size is shared again among the others."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        share = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > cap * sizes[i]}
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else share * weights[i]
        if not over:
            break
        open_ -= over
        rest -= sum(out[i] for i in over)
    return out


def slot_counts(sizes: list[int], goals: list[float], block: int, cap: int = MAX_EPOCHS) -> list[tuple[int, int]]:
    """(blocks, slots) of each source: whole epochs, and of the last one as many blocks as come nearest the target."""
    out = []
    for size, goal in zip(sizes, goals):
        n = -(-size // block)
        whole = int(goal // size) if size else 0
        part = round((goal - whole * size) / (size / n)) if size else 0
        out.append((n, min(whole * n + part, cap * n)))
    return out


def draw(slots: list[int], shards: int, seed: int) -> list[list[int]]:
    """Source counts of each shard: multinomial draws that add up to `slots`."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = []
    for k in range(shards):
        m = int(left.sum()) // (shards - k)
        got = np.zeros_like(left)
        while (short := m - int(got.sum())) > 0:
            rest = left - got
            got += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        out.append([int(x) for x in got])
        left -= got
    return out


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): four Feistel rounds, walked until back in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.ones(len(x), bool)
    while todo.any():
        a, b = out[todo] >> bits, out[todo] & mask
        for r in range(4):
            a, b = b, a ^ (spread(b + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask)
        out[todo] = (a << bits) | b
        todo = out >= n
    return out.astype(np.int64)


def _slots(spark, plan: list[tuple], seed: int) -> DataFrame:
    """(shard, slot, s, index, epoch), one row for each slot of the output."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                slot = np.arange(r["first"], r["first"] + r["n"])
                epoch = slot // r["blocks"]
                index = np.empty_like(slot)
                for e in np.unique(epoch):
                    at = epoch == e
                    index[at] = permute(slot[at] % r["blocks"], r["blocks"], seed + 1000 * r["s"] + int(e))
                shard, s = np.full(len(slot), r["shard"], np.int32), np.full(len(slot), r["s"], np.int32)
                cols = [pa.array(x) for x in (shard, slot, s, index, epoch.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "slot", "s", "index", "epoch"])

    ranges = spark.createDataFrame(plan, "shard int, s int, blocks long, first long, n long")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_CHUNK).cast("long")))
    chunks = ranges.withColumn("at", start).select(
        "shard", "s", "blocks", (F.col("first") + F.col("at")).alias("first"),
        F.least(F.col("n") - F.col("at"), F.lit(_CHUNK)).cast("long").alias("n"),
    )
    # A number of its own, as the plan's rows are too small to show how many slots come of them.
    tasks = max(8, sum(r[4] for r in plan) // (8 * _CHUNK))
    by = chunks.repartition(tasks, "shard", "s", "first")
    return by.mapInArrow(unfold, "shard int, slot long, s int, index long, epoch int")


class Mix:
    """`rows` (doc_id, tie, source, size, source_size, target, s, off) and `placements` of one mix of `docs`.

    placements: (shard, slot, epoch, s, off, row, lo, hi): words [lo, hi) of a document, once for each time that the mix
    takes them. `row`: the column of `docs` that numbers its rows, if there is one.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, row: str | None = None):
        spark = docs.sparkSession
        base = materialise(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"),
                F.col("source").cast("string").alias("source"),
                word_count(F.col("text")).alias("size"),
                (F.col(row) if row else F.lit(None).cast("long")).alias("row"),
            )
        )
        of = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        of = sorted(of, key=lambda r: (r["source"] is None, r["source"]))
        sizes = [r["size"] for r in of]
        goals = targets(sizes, [weights[i % len(weights)] for i in range(len(of))])
        counts = slot_counts(sizes, goals, block)
        shards = max(shards, -(-sum(k for _, k in counts) // SHARD_SLOTS))
        plan, given = [], [0] * len(of)
        for shard, drawn in enumerate(draw([k for _, k in counts], shards, seed)):
            for s, n in enumerate(drawn):
                if n:
                    plan.append((shard, s, counts[s][0], given[s], n))
                    given[s] += n
        about = [(r["source"], s, sizes[s], goals[s]) for s, r in enumerate(of)]
        about = spark.createDataFrame(about, "_source string, s int, source_size long, target double")
        order = [F.col("doc_id"), F.col("tie")]
        rows = running_offsets(base, ["source"], F.col("size"), order, salts_for(sum(r["n"] for r in of)), "off", ("row",))
        rows = rows.join(about, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        self.rows = materialise(rows)
        first, last = F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block)
        parts = self.rows.filter("size > 0").withColumn("index", F.explode(F.sequence(first, last)))
        lo = F.greatest(F.col("index") * block - F.col("off"), F.lit(0))
        hi = F.least((F.col("index") + 1) * block - F.col("off"), F.col("size"))
        parts = parts.select("s", "index", "off", "row", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
        # Planned from a small table, but as long as the output: it mustn't be taken for one to broadcast.
        slots = _slots(spark, plan, seed).hint("merge")
        self.placements = parts.join(slots, ["s", "index"]).select(
            "shard", "slot", "epoch", "s", "off", "row", "lo", "hi"
        )


def takes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of `docs`."""
    mixed = Mix(docs, **options)
    taken = mixed.placements.groupBy("s", "off").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    taken = taken.withColumnsRenamed({"s": "_s", "off": "_off"})
    same = (F.col("s") == F.col("_s")) & (F.col("off") == F.col("_off")) & (F.col("size") > 0)
    out = mixed.rows.join(taken, same, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` as the mix takes them: a row for each document and epoch, its text the words taken in that epoch.

    Rows keep their other columns (n_chars, where it exists, is counted anew); a text taken whole stays as it is.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for x, taken, whole in zip(b.column("_text"), b.column("_taken"), b.column("_whole")):
                text = x.as_py()
                if not whole.as_py():
                    words = text.encode("utf-8", "surrogatepass").split()
                    kept = [w for r in taken.as_py() for w in words[r["lo"] : r["hi"]]]
                    text = b" ".join(kept).decode("utf-8", "surrogatepass")
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(out, pa.string())], ["_row", "_text"])

    # Rows are numbered once and for all, so each meets what was taken of it whatever ids and texts repeat.
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*named(rest)).alias("_row"), "doc_id", "source", "text", F.monotonically_increasing_id().alias("_mix_row"))
    rows = materialise(rows)
    mixed = Mix(rows, row="_mix_row", **options)
    ranges = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    taken = mixed.placements.groupBy("row", "epoch").agg(ranges.alias("_taken"), F.sum(F.col("hi") - F.col("lo")).alias("_n"))
    size = mixed.rows.select(F.col("row").alias("_of"), F.col("size").alias("_size"))
    taken = taken.join(size, F.col("row") == F.col("_of")).select("row", "_taken", (F.col("_n") == F.col("_size")).alias("_whole"))
    both = rows.join(taken, F.col("_mix_row") == F.col("row")).select("_row", F.col("text").alias("_text"), "_taken", "_whole")
    done = both.mapInArrow(cut, both.select("_row", "_text").schema)
    out = {c: F.col("_row")[c] for c in rest} | {"text": F.col("_text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[out[c].alias(c) for c in docs.columns])
