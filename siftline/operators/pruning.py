"""Exact nearest vectors without comparing all: parts around pivots, and angles that prove which parts can't hold a hit.

1. Some rows, a bounded number, are pivots. Each row belongs to the pivot with the smallest angle to it; a part knows the
   smallest and the largest of these angles.
2. Each query is ranked in its own part first. The angle of its k-th hit there is a bound: nothing further away can be
   among the first k.
3. By the triangle inequality no row of a part is nearer to a query than the query's angle to the pivot lies outside the
   part's angles. Parts whose least angle is above the bound are left out; a query goes to the others only.
4. Parts are dealt in blocks of rows, and the queries sent to a part in blocks of queries; a task ranks one by the other.

A row is copied once for each block of queries that its own part gets, a query to each block of the parts it can't leave
out, so work follows what the bounds leave, which is little where vectors lie in groups and all where they lie anywhere.

Defined results: those of `retrieval.block_search`. Vectors that are null or hold null or non-finite components take no
part; zero vectors score 0 with all; shorter vectors count as ending in zeros; ties (to nine digits) go to the smaller
id; ids that repeat are rows each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.functions.running import checkpointing
from siftline.operators.retrieval import _padded, ranked_block

#: Pivots: the square root of the rows, within these.
PIVOTS = (4, 256)
ROW_BLOCK, QUERY_BLOCK = 8_192, 4_096
#: What rounding may add to an angle.
_MARGIN = 1e-6


def _angles(col: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle of each row with each pivot, which rows are zero)."""
    v = _padded(pa.chunked_array([col]))
    width = max(v.shape[1], pivots.shape[1])
    v, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, pivots))
    norm = np.sqrt((v * v).sum(axis=1))
    unit = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
    return np.arccos(np.clip(unit @ p.T, -1, 1)), norm == 0


def _usable(df: DataFrame, key: str) -> DataFrame:
    v = F.transform("vector", lambda x: x.cast("double"))
    df = df.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return df.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


class Parts:
    """What tasks have to know: the pivots, and of each part its rows and its smallest and largest angle."""

    def __init__(self, pivots: np.ndarray, min_score: float | None):
        self.pivots, self.min_score = pivots, min_score
        self.parts: dict[int, tuple[int, float, float]] = {}

    def home(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Zero rows are a part of their own, -1, at a right angle to everything."""
        for b in batches:
            if b.num_rows:
                angle, zero = _angles(b.column("v"), self.pivots)
                part = np.where(zero, -1, angle.argmin(axis=1)).astype(np.int32)
                least = np.where(zero, np.pi / 2, angle.min(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(part), pa.array(least)], ["id", "v", "part", "angle"])

    def own(self, angle: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """The part that each query is ranked in first: that of the nearest pivot which has rows."""
        parts = np.array(sorted(p for p in self.parts if p >= 0) or [-1])
        return np.where(zero | (parts[0] < 0), min(self.parts), parts[angle[:, parts].argmin(axis=1)]).astype(np.int32)

    def first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and self.parts:
                own = self.own(*_angles(b.column("v"), self.pivots))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("n"), pa.array(own)], ["id", "v", "n", "part"])

    def sent(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each further part that a query can't leave out."""
        for b in batches:
            if not b.num_rows or not self.parts:
                continue
            angle, zero = _angles(b.column("v"), self.pivots)
            least = b.column("least").to_numpy(zero_copy_only=False).astype(float)
            reach = np.where(np.isnan(least), np.pi, np.arccos(np.clip(least, -1, 1)))
            if self.min_score is not None:
                reach = np.minimum(reach, np.arccos(np.clip(self.min_score, -1, 1)))
            own, row, part = self.own(angle, zero), [], []
            for p, (_, lo, hi) in self.parts.items():
                far = np.pi / 2 if p < 0 else np.maximum(angle[:, p] - hi, lo - angle[:, p])
                far = np.where(zero, np.pi / 2, far)
                goes = np.flatnonzero((far <= reach + _MARGIN) & (own != p))
                row.append(goes), part.append(np.full(len(goes), p))
            row = pa.array(np.concatenate(row))
            cols = [b.column(c).take(row) for c in ("id", "v", "n")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(part).astype(np.int32))], ["id", "v", "n", "part"])


class Search:
    """`hits`: (query_id, rank, id, score). `skipped`: the share of (query, part) pairs that the bounds left out."""

    def __init__(self, rows: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK):
        spark = rows.sparkSession
        checkpointing(spark)
        held, asked = _usable(rows, "id"), _usable(queries, "query_id").withColumn("n", F.monotonically_increasing_id())
        self.k, self.min_score, self.row_block, self.query_block = k, min_score, row_block, query_block
        n_rows = held.count()
        some = held.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id", "v"), "id")
        some = some.limit(min(max(int(n_rows**0.5), PIVOTS[0]), PIVOTS[1])).toArrow()
        pivots = _padded(some.column("v")) if some.num_rows else np.ones((1, 1))
        known = Parts(pivots / np.linalg.norm(pivots, axis=1, keepdims=True), min_score)
        self.held = held.mapInArrow(known.home, "id long, v array<double>, part int, angle double").checkpoint()
        stats = self.held.groupBy("part").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()
        known.parts = self.parts = {r["part"]: (r["n"], r["lo"], r["hi"]) for r in stats}
        asked = asked.checkpoint()
        kind = "id long, v array<double>, n long, part int"
        first = asked.mapInArrow(known.first, kind)
        near = self._ranked(first)
        # A query has k hits in its own part, or no bound.
        bound = near.groupBy("n").agg(F.count("*").alias("found"), F.min("score").alias("least")).filter(F.col("found") >= k)
        bounded = asked.join(bound.select("n", "least"), "n", "left").select("id", "v", "n", "least")
        sent = bounded.mapInArrow(known.sent, kind).checkpoint()
        n_asked, n_sent = asked.count(), sent.count() + (asked.count() if self.parts else 0)
        self.skipped = 1 - n_sent / (n_asked * len(self.parts)) if n_asked and self.parts else 0.0
        found = near.union(self._ranked(sent))
        order = W.partitionBy("n").orderBy(F.desc("_near"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        self.hits = ranked.select("query_id", "rank", "id", "score")

    def _ranked(self, asked: DataFrame) -> DataFrame:
        """(query_id, id, score, _near, n): each block's own k best of each query sent to it."""
        sizes = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
        k, least = self.k, self.min_score

        def blocks(size: dict[int, int], of: int) -> Column:
            lines = [F.lit(x) for p in sizes for x in (p, -(-size[p] // of))]
            return F.element_at(F.create_map(*lines), F.col("part")).cast("int") if lines else F.lit(None).cast("int")

        n_rows, n_asked = blocks({p: n for p, (n, _, _) in self.parts.items()}, self.row_block), blocks(sizes, self.query_block)
        rows = self.held.withColumn("_r", F.pmod(F.xxhash64("id", "v"), n_rows).cast("int")).filter("_r IS NOT NULL")
        rows = rows.select("id", "v", F.lit(None).cast("long").alias("n"), "part", "_r", F.explode(F.sequence(F.lit(0), n_asked - 1)).alias("_q"))
        asked = asked.withColumn("_q", F.pmod(F.xxhash64("n"), n_asked).cast("int"))
        asked = asked.select("id", "v", "n", "part", F.explode(F.sequence(F.lit(0), n_rows - 1)).alias("_r"), "_q")

        def best(block: pa.Table) -> pa.Table:
            asks = block.column("n").is_valid().to_numpy()
            return ranked_block(block, asks, k, least, "n")

        both = rows.unionByName(asked).groupBy("part", "_r", "_q")
        return both.applyInArrow(best, "query_id long, id long, score double, _near double, n long")


def pruned_search(rows: DataFrame, queries: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, rank, id, score), as `retrieval.block_search` gives them."""
    return Search(rows, queries, k, min_score).hits
