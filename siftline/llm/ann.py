"""Nearest neighbours by learned partitions.

On a bounded sample: the graph of each vector's nearest neighbours is cut into balanced parts (parts grow along the
graph from spread seeds, then vectors move to the part most of their neighbours are in, as long as sizes stay within
a slack), and a small softmax classifier learns from the vector which part it is in. The index then puts every row in
its most probable part; a query is routed to the several most probable ones, whose rows are reranked exactly. Parts
larger than a block are dealt over several tasks, and so are the queries routed to a part: a task holds one block of rows
and one of queries, whose numbers are both bounded, and ranks them in pages. There are more parts the more rows there are.

The sample of `SAMPLE` rows bounds what the driver learns from; everything else covers all rows. Recall against brute
force is measured in the tests (0.9 at least).

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part; ties go to the smaller vec_id; repeated rows are candidates each, and ask once; an id with
several vectors asks with each, and has ranks from 1 for each; rows without vec_id take no part; with fewer candidates
than asked for, all that were found are returned; texts and other columns, whatever their names, are not read; an empty
table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.llm.common import materialise

#: Rows that the partitioning and the classifier are fitted on, at most.
SAMPLE = 8_192
#: Parts, and rows of the sample that each has at least; finer parts leave a query fewer rows to rank. Where parts would
#: have more than ROWS_PER_PART rows there are more of them, down to FEWEST rows of the sample for each.
PARTS, PER_PART = 128, 64
ROWS_PER_PART, FEWEST = 65_536, 16
#: Share of the true neighbours that routing has to reach on the sample.
RECALL = 0.95
#: Sample queries that this is measured on, at most.
PROBED = 1_024
TOP = 20
#: Rows of a part that one task ranks, and queries that it ranks them for.
BLOCK = 16_384
SEED = 11
_PAGE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that can be searched, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows (by inner product) of each row of the sample, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        near = x[lo : lo + 1024] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size that keep neighbours together."""
    rng, n = np.random.default_rng(seed), len(x)
    most = int(np.ceil(1.1 * n / parts))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    seeds = [int(rng.integers(n))]
    far = unit @ unit[seeds[0]]
    while len(seeds) < parts:  # seeds that are least like those before
        seeds.append(int(np.argmin(far)))
        far = np.maximum(far, unit @ unit[seeds[-1]])
    part = np.argmax(unit @ unit[seeds].T, axis=1)
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1)])
    both = np.concatenate([both, both[:, ::-1]])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (both[:, 0], part[both[:, 1]]), 1)
        centre = np.stack([unit[part == p].mean(axis=0) if (part == p).any() else unit[seeds[p]] for p in range(parts)])
        wish = votes + 4 * (unit @ centre.T)
        part = np.full(n, -1)
        room = np.full(parts, most)
        order = np.argsort(-(np.max(wish, axis=1) - np.mean(wish, axis=1)), kind="stable")
        ranked = np.argsort(-wish, axis=1, kind="stable")
        for i in order:
            part[i] = next(p for p in ranked[i] if room[p])
            room[part[i]] -= 1
    return part


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from unit vectors to parts, by full-batch Adam."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    w, b, want = np.zeros((x.shape[1], parts)), np.zeros(parts), np.eye(parts)[part]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = unit @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - want) / len(x)
        for k, (theta, grad) in enumerate(((w, unit.T @ g + 1e-5 * w), (b, g.sum(axis=0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w, b


def probes_for(x: np.ndarray, w: np.ndarray, b: np.ndarray, top: int, recall: float) -> int:
    """The fewest parts that hold the wanted share of the sample's true neighbours."""
    z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ w + b
    part, asked = z.argmax(axis=1), min(PROBED, len(x))
    k = min(top, len(x) - 1)
    if k < 1:
        return z.shape[1]
    near = x[:asked] @ x.T
    near[np.arange(asked), np.arange(asked)] = -np.inf
    true = part[np.argpartition(-near, k - 1, axis=1)[:, :k]]
    place = np.argsort(np.argsort(-z[:asked], axis=1, kind="stable"), axis=1)
    found = np.take_along_axis(place, true, axis=1)
    return next(m for m in range(1, z.shape[1] + 1) if m == z.shape[1] or (found < m).mean() >= recall)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of one vector, or of each row, with rows, summed component by component, so equal vectors always
    score equal."""
    out = np.zeros(len(c))
    for k in range(c.shape[1]):
        out += q[..., k] * c[:, k]
    return out


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's row, score) of the nearest candidates of some queries; fast products preselect, exact sums
    decide."""
    near = q @ c.T
    near[q_ids[:, None] == ids] = -np.inf
    if len(ids) > top:
        edge = np.partition(near, len(ids) - top, axis=1)[:, len(ids) - top]
        widest = np.abs(np.where(np.isfinite(near), near, 0.0)).max(axis=1)
        slack = 1e-9 * (1 + widest)
        keep = near >= np.where(np.isfinite(edge), edge - slack, -np.inf)[:, None]
    else:
        keep = np.ones(near.shape, bool)
    row, col = np.nonzero(keep & np.isfinite(near))
    score = exact(q[row], c[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(q)))
    held = np.arange(len(row)) - first[row] < top
    return row[held], col[held], score[held]


def nearest(
    vectors: DataFrame,
    every: int = 20,
    top: int = TOP,
    parts: int = PARTS,
    recall: float = RECALL,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    rows = rows.filter(F.size("v") == dim)
    learn = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample).toArrow()
    x = _matrix(learn.column("v").combine_chunks(), dim)
    n_parts = max(1, min(parts, len(x) // PER_PART), min(-(-sizes[0]["count"] // ROWS_PER_PART), len(x) // FEWEST))
    if n_parts > 1:
        graph = neighbour_graph(x, min(10, len(x) - 1))
        w, b = fit_router(x, balanced_parts(x, graph, n_parts, SEED), n_parts)
    else:
        w, b = np.zeros((dim, 1)), np.zeros(1)
    probes = probes_for(x, w, b, top, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            m = _matrix(r.column("v"), dim)
            z = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ w + b
            order = np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32)
            ends = pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32))
            to = pa.ListArray.from_arrays(ends, pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([r.column("vec_id"), r.column("v"), to], ["vec_id", "v", "to"])

    routed = materialise(rows.mapInArrow(route, "vec_id long, v array<double>, to array<int>"))
    part = F.get("to", F.lit(0)).alias("part")
    counts = {r["part"]: r["n"] for r in routed.groupBy(part).agg(F.count("*").alias("n")).collect()}
    asks = routed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asks = asks.select(F.explode("to").alias("part"), "vec_id", "v", F.lit(True).alias("asks"))
    asked = {r["part"]: r["n"] for r in asks.groupBy("part").agg(F.count("*").alias("n")).collect()}

    def dealt(rows: DataFrame, own: str, own_counts: dict, other: str, other_counts: dict, *by: str) -> DataFrame:
        """Each row in one block of its own kind, beside every block of the other kind; both have lines in all parts kept."""
        def blocks(counts: dict) -> Column:
            sizes = [F.lit(y) for p, n in counts.items() if p in own_counts and p in other_counts for y in (p, -(-n // block))]
            return F.element_at(F.create_map(*sizes), F.col("part")).cast("int") if sizes else F.lit(None).cast("int")

        rows = rows.withColumn(own, F.pmod(F.xxhash64(*by), blocks(own_counts)).cast("int")).filter(F.col(own).isNotNull())
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), blocks(other_counts) - 1)))

    cand = routed.select(part, "vec_id", "v", F.lit(False).alias("asks"))
    cand = dealt(cand, "i", counts, "j", asked, "vec_id", "v")
    asks = dealt(asks, "j", asked, "i", counts, "vec_id", "v")
    both = cand.unionByName(asks).withColumn("ask", F.when(F.col("asks"), F.xxhash64("v")).otherwise(0))

    def rank(block: pa.Table) -> pa.Table:
        asking = block.filter(block.column("asks"))
        held = block.filter(pc.invert(block.column("asks")))
        out = [[], [], [], []]
        if held.num_rows and asking.num_rows:
            ids, c = held.column("vec_id").to_numpy(), _matrix(held.column("v").combine_chunks(), dim)
            q_ids, keys, q = asking.column("vec_id").to_numpy(), asking.column("ask").to_numpy(), _matrix(asking.column("v").combine_chunks(), dim)
            for lo in range(0, len(q), _PAGE):
                row, col, score = best(q_ids[lo : lo + _PAGE], q[lo : lo + _PAGE], ids, c, top)
                out[0].append(q_ids[lo + row]), out[1].append(ids[col]), out[2].append(score), out[3].append(keys[lo + row])
        flat = [np.concatenate([np.zeros(0, t), *o]) for o, t in zip(out, (np.int64, np.int64, np.float64, np.int64))]
        return pa.table({"query_id": flat[0], "vec_id": flat[1], "score": flat[2], "ask": flat[3]})

    found = both.groupBy("part", "i", "j").applyInArrow(rank, "query_id long, vec_id long, score double, ask long")
    order = W.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
