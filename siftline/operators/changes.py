"""Versions of content over time: what changed, line diffs, pruning; and breadth-first crawls of a link table."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siftline.functions.running import checkpointing, totals


def history(versions: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, content_hash, previous_hash, kind): first, same or changed against the version before.

    Versions are numbered as narrow rows, and each meets the one before by its number, so a key with very many of them
    is spread as others are.
    """
    rows = versions.select(key, order, F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"))
    rows = totals(rows, [key], [order], _no=F.lit(1))
    before = rows.select(F.col(key).alias("_key"), (F.col("_no") + 1).alias("_next"), F.col("content_hash").alias("previous_hash"))
    rows = rows.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_no") == F.col("_next")), "left")
    kind = F.when(F.col("previous_hash").isNull(), "first").when(F.col("previous_hash") == F.col("content_hash"), "same")
    return rows.select(key, order, "content_hash", "previous_hash", kind.otherwise("changed").alias("kind"))


def prune(versions: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    by = W.partitionBy(key).orderBy(F.desc(order))
    return versions.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= keep).drop("_k")


def latest(versions: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    best = F.max_by(F.struct(order, *columns), order).alias("_v")
    return versions.groupBy(key).agg(best).select(key, "_v.*")


def line_diff(old: list[str], new: list[str]) -> list[tuple[str, int]]:
    """[(kind, line number)] of a longest-common-subsequence alignment; where both ways are as long, lines count as
    added last. Numbers are from 1: of the new text for added and unchanged lines, of the old one for removed lines."""
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(x, len(codes)) for x in side] for side in (old, new))
    right = np.array(b, np.int64)

    def below(row: np.ndarray, x: int) -> np.ndarray:
        """The next row of the table of common lengths."""
        out = np.zeros_like(row)
        out[1:] = np.maximum.accumulate(np.maximum(row[:-1] + (right == x), row[1:]))
        return out

    # Only every step-th row is kept; those between are computed again when the way back comes to them, so two texts of
    # n lines take memory for n * sqrt(n) numbers, not n * n.
    step = max(1, int(np.sqrt(len(a))))
    row = np.zeros(len(b) + 1, np.int32)
    kept = [row]
    for i, x in enumerate(a):
        row = below(row, x)
        if (i + 1) % step == 0:
            kept.append(row)
    out, i, j, low, table = [], len(a), len(b), len(a) + 1, []
    while i or j:
        if i and i - 1 < low:
            low = (i - 1) // step * step
            table = [kept[low // step]]
            for x in a[low : min(low + step, len(a))]:
                table.append(below(table[-1], x))
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("unchanged", j + 1))
        elif j and (not i or table[i - low][j - 1] >= table[i - 1 - low][j]):
            j -= 1
            out.append(("added", j + 1))
        else:
            i -= 1
            out.append(("removed", i + 1))
    return out[::-1]


def summary(kinds: list[str]) -> str:
    """Blocks of removed and then added lines are modified sections; others are added or removed ones."""
    counts = {"added": 0, "removed": 0, "modified": 0}
    block: set[str] = set()
    for kind in [*kinds, "unchanged"]:
        if kind == "unchanged":
            if block:
                counts["modified" if len(block) == 2 else block.pop()] += 1
            block = set()
        else:
            block.add(kind)
    parts = [f"{n} section{'s' if n > 1 else ''} {k}" for k, n in counts.items() if n]
    return ", ".join(parts) or "no changes"


def diffs(versions: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, added, removed, unchanged, change_percent, summary) of each version against the one before.

    Versions are numbered as narrow rows; a pair meets its two texts by equal keys, so no task sorts the texts of a key.
    The alignment is a per-row Arrow map. `order` is unique within a key.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            added, removed, same, percent, says = [], [], [], [], []
            for old, new in zip(b.column("_old").to_pylist(), b.column("_new").to_pylist()):
                left, right = (old or "").split("\n"), (new or "").split("\n")
                kinds = [k for k, _ in line_diff(left, right)]
                plus, minus = kinds.count("added"), kinds.count("removed")
                added.append(plus), removed.append(minus), same.append(len(kinds) - plus - minus)
                percent.append(round(100 * (plus + minus) / max(len(left), len(right), 1), 2)), says.append(summary(kinds))
            cols = [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (added, removed, same)), pa.array(percent, pa.float64()), pa.array(says, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [key, order, "added", "removed", "unchanged", "change_percent", "summary"])

    numbered = totals(versions.select(key, order), [key], [order], _no=F.lit(1))
    later = numbered.select(F.col(key).alias("_key"), (F.col("_no") - 1).alias("_no"), F.col(order).alias("_later"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (numbered["_no"] == later["_no"])
    pairs = numbered.join(later, same).select("_key", F.col(order).alias("_earlier"), "_later")
    old, new = (
        versions.select(F.col(key).alias(f"_k_{n}"), F.col(order).alias(f"_o_{n}"), F.col(text).alias(f"_{n}")) for n in ("old", "new")
    )
    for side, at, name in ((old, "_earlier", "old"), (new, "_later", "new")):
        pairs = pairs.join(side, F.col("_key").eqNullSafe(F.col(f"_k_{name}")) & (F.col(at) == F.col(f"_o_{name}")))
    rows = pairs.select(F.col("_key").alias(key), F.col("_later").alias(order), "_old", "_new")
    kinds = {f.name: f.dataType.simpleString() for f in versions.schema}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, added long, removed long, unchanged long, change_percent double, summary string"
    return rows.mapInArrow(align, schema)


def crawl(edges: DataFrame, start: list, max_depth: int) -> DataFrame:
    """(node, depth): the least number of links from a start to each page it reaches within `max_depth`.

    Each level joins only the frontier to the links and drops what was visited; levels are checkpointed, so plans stay
    short and a lost executor costs one level.
    """
    spark = edges.sparkSession
    checkpointing(spark)
    frontier = spark.createDataFrame([(s,) for s in start], f"node {edges.schema['src'].dataType.simpleString()}").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.withColumn("depth", F.lit(depth)))
    return seen


def crawl_statistics(pages: DataFrame, status: str, tokens_in: str, tokens_out: str, host: str) -> DataFrame:
    return pages.agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col(status) == "ok").alias("n_ok"),
        F.count_if(F.col(status) == "blocked").alias("n_blocked"),
        F.sum(tokens_in).alias("tokens_in"),
        F.sum(tokens_out).alias("tokens_out"),
        F.floor((1 - F.sum(tokens_out) / F.sum(tokens_in)) * 100 + 0.5).cast("long").alias("savings_percent"),
        F.countDistinct(host).alias("n_hosts"),
    )
