"""Centroid clustering in exact integers, by matrix products in double precision.

Each component x of a vector becomes the integer floor(64 x), which a double holds exactly. A task takes its vectors in
blocks and gets all squared distances of a block from one matrix product, |x|^2 - 2 x.c + |c|^2. Vectors for which
d (max |x| + max |c|)^2 stays below 2^53 come out exact that way, in whatever order BLAS adds; all others are counted in
Python's integers of any size. A block gives one row of sums for each cluster, a task adds its blocks, and
`RDD.treeAggregate` adds the tasks in levels, so the driver receives no more than a few sets of k sums of any number of
tasks. Sums are exact, so the result depends on no order and reruns agree.

Defined results: vectors that are null, of another length than asked for, or hold null or non-finite components are left
out; repeated rows count each and can both be starts; equal hashes are ordered by the components; a row without vec_id
hashes an empty number; with fewer vectors than clusters there are as many clusters as vectors; ties go to the smaller
cluster; a distance or sum too large for a long is null, though clusters and centroids are still exact; other columns
are not read, whatever their names; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import materialise

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Rows of one matrix product.
BLOCK = 4096
#: Products stay exact below this, with a bit to spare for the bound's own rounding.
EXACT = 2.0**52
_LONG = 1 << 63

#: For each cluster: [vectors, sum of distances, sums of the components].
Sums = dict[int, tuple[int, int, list[int]]]


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v): the vectors of `dim` finite components."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return rows.filter(F.coalesce((F.size("v") == dim) & ~odd, F.lit(False)))


def integers(v: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each component, of any size."""
    return [p * scale // q for p, q in (float(x).as_integer_ratio() for x in v)]


def assign(x: np.ndarray, centroids: list[list[int]], scale: int) -> tuple[np.ndarray, list[int], np.ndarray, dict[int, list[int]]]:
    """(cluster, distance, whole, large) of each row of x. whole: the integers as doubles, for all rows that `large`,
    which holds the integers of rows beyond exact doubles, doesn't name."""
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
        most_c = max(abs(y) for c in centroids for y in c)
        fast = np.full(len(x), False)
        if most_c < EXACT:
            fast = x.shape[1] * (np.abs(whole).max(axis=1) + float(most_c)) ** 2 < EXACT
    whole = np.where(fast[:, None], whole, 0.0)
    cluster, distance = np.zeros(len(x), np.int64), [0] * len(x)
    if fast.any():
        c = np.array(centroids, float)
        far = (whole * whole).sum(axis=1)[:, None] - 2 * (whole @ c.T) + (c * c).sum(axis=1)
        cluster = far.argmin(axis=1)  # the first of equals
        distance = far[np.arange(len(x)), cluster].astype(np.int64).tolist()
    large = {}
    for i in np.flatnonzero(~fast).tolist():
        y = large[i] = integers(x[i].tolist(), scale)
        distance[i], cluster[i] = min((sum((a - b) ** 2 for a, b in zip(y, c)), k) for k, c in enumerate(centroids))
    return cluster, distance, whole, large


def added(a: Sums, b: Sums) -> Sums:
    out = dict(a)
    for k, (n, far, sums) in b.items():
        m, other, before = out.get(k, (0, 0, [0] * len(sums)))
        out[k] = (m + n, other + far, [x + y for x, y in zip(before, sums)])
    return out


def _blocks(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for lo in range(0, b.num_rows, BLOCK):
        part = b.slice(lo, BLOCK)
        yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _sums(rows: DataFrame, centroids: list[list[int]], scale: int) -> Sums:
    dim = len(centroids[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for b in batches:
            for _, x in _blocks(b, dim):
                cluster, distance, whole, large = assign(x, centroids, scale)
                member = np.zeros((len(centroids), len(x)))
                member[cluster, np.arange(len(x))] = 1
                sums = member @ whole  # of a block, exact as well: whole numbers far below 2^26
                parts = {k: [0, 0, [int(s) for s in sums[k].tolist()]] for k in np.unique(cluster).tolist()}
                for k, far in zip(cluster.tolist(), distance):
                    parts[k][0] += 1
                    parts[k][1] += far
                for i, y in large.items():
                    of = parts[int(cluster[i])]
                    of[2] = [s + t for s, t in zip(of[2], y)]
                total = added(total, {k: tuple(p) for k, p in parts.items()})
        flat = [(k, n, str(far), [str(s) for s in sums]) for k, (n, far, sums) in total.items()]
        cols = list(zip(*flat)) or [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["cluster", "n", "far", "sums"])

    parts = rows.select("v").mapInArrow(partial, "cluster int, n long, far string, sums array<string>")

    def fold(total: Sums, r) -> Sums:
        return added(total, {r["cluster"]: (r["n"], int(r["far"]), [int(s) for s in r["sums"]])})

    return parts.rdd.treeAggregate({}, fold, added)


def _long(x: int) -> int | None:
    return x if -_LONG <= x < _LONG else None


def clusters(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable row of `vectors`."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = materialise(usable(vectors, dim))
    number = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    starts = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), number), 256), "v").limit(k).collect()
    if not starts:
        return rows.sparkSession.createDataFrame([], schema)
    centroids = [integers(r["v"], scale) for r in starts]
    for _ in range(rounds):
        for at, (n, _, sums) in _sums(rows, centroids, scale).items():
            centroids[at] = [s // n for s in sums]
    inertia = {at: far for at, (_, far, _) in _sums(rows, centroids, scale).items()}
    whole = _long(sum(inertia.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _blocks(b, dim):
                cluster, distance, _, _ = assign(x, centroids, scale)
                at = cluster.tolist()
                cols = [
                    part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(map(_long, distance), pa.int64()),
                    pa.array([_long(inertia[c]) for c in at], pa.int64()), pa.array([whole] * len(at), pa.int64()),
                    pa.array([digest[c] for c in at], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(place, schema)


def oracle() -> str:
    """DuckDB SQL of the definition, for components whose integers a long holds."""
    far = "list_sum(list_transform(range(1, {d} + 1), lambda i: ((v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))::HUGEINT))".format(d=DIM)
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT k, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), x) - 1 AS k FROM v) WHERE k < {CLUSTERS}
)"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(vx) AS x, min(far) AS far, arg_min(k, (far, k)) AS k
  FROM (SELECT v.rid, v.vec_id, v.x AS vx, c.k, {far} AS far FROM (SELECT *, row_number() OVER () AS rid FROM v) v CROSS JOIN c{r} c) GROUP BY rid
)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x
    FROM (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, unnest(range(1, {DIM} + 1)) AS i FROM a{r}) GROUP BY k, i)
    GROUP BY k) m USING (k)
)""")
    return ", ".join(parts) + f"""
SELECT vec_id, a.k::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.k = c.k"""
