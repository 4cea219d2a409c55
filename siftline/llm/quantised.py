"""Near-duplicate vectors: codes by iterative quantisation, multi-index Hamming tables, exact cosines.

1. Equal vectors are one class with a number of copies; from here on classes (nodes) count.
2. On a bounded sample rotations are learned that bring the vectors close to the corners of a cube (iterative
   quantisation; of linked rows one counts); thresholds at the medians balance the bits. The codes of several rotations
   are cut into tables of about log2(rows) bits. Pairs made from the sample at exactly the cosine sought tell how many
   tables find the wanted share of them, and how far apart their codes may be.
3. Keys that very many nodes share are dense places: one of their nodes leads a cell, which its near ones join, so the
   tables hold a cell once, however many members it has. Where leaders attract few, nodes go to their nearest leader.
   Nodes elsewhere that share a key with a cell and are near its leader join it as well.
4. Units (cells, and nodes in none) that share a key are candidates. Two single nodes are compared if their codes are
   close enough. Members of a cell within half the angle of its leader are linked by the triangle inequality, and only
   counted; the others, and the nodes of units near the cell, are compared with its members by matrix products, block by
   block, of which only counts for each node and one representative of what is linked come out.

So a group of tight copies costs a few rows for each of its members and pairs none of them; a loose one is compared in
blocks of bounded size, as its number of links can't be known otherwise. Recall is measured in the tests; no pair below
the cosine is ever linked.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
are linked with nothing and are their own component, as are rows without vec_id, whose component is null and which are
kept; repeated rows are vectors each, linked with each other; an id that repeats with other vectors has a row for each;
ties need no order, as every link counts; other columns are not read, whatever their names; an empty table gives no
rows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import discard, lookup, materialise
from siftline.llm.neardup import _written, components

COSINE = 0.95
#: Rows that the rotations are learned on, at most, and bits of one rotation.
SAMPLE, BITS = 8_192, 64
#: Share of the pairs at exactly the cosine sought that the tables have to hold, and that may pass by their codes' distance.
RECALL, PASS = 0.99, 0.9999
#: Bits of a key: log2 of the rows, within these.
KEY_BITS = (8, 32)
#: Nodes with one key that make it a dense place.
DENSE = 128
#: Cells are formed by near ones while they take this share of the nodes at dense places.
WORTH = 0.25
#: Rows of one side of a matrix product.
BLOCK = 2_048
SEED = 13
#: Angles proven by others' sums leave this much for rounding.
_MARGIN = 1e-6


def rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, thresholds): the signs of x @ matrix - thresholds are the code. Principal directions, turned so that the
    sample lies close to the corners of a cube (Gong and Lazebnik, 2011), and cut at the medians."""
    centred = x - x.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    v = centred @ axes
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    matrix = axes @ r
    return matrix, np.median(x @ matrix, axis=0)


def thinned(x: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of x no two of which are linked and that all others are linked with, so a large group of copies counts once:
    the medians would cut it in halves otherwise."""
    kept = x[:0]
    for lo in range(0, len(x), BLOCK // 4):
        part = x[lo : lo + BLOCK // 4]
        part = part[~(part @ kept.T >= cosine).any(axis=1)]
        on, stays = np.triu(part @ part.T >= cosine, 1), np.ones(len(part), bool)
        for k in range(len(part)):
            if stays[k]:
                stays[on[k]] = False
        kept = np.concatenate([kept, part[stays]])
    return kept


class Tables:
    """The learned tables: `keys` gives each vector's key in each of them."""

    def __init__(self, x: np.ndarray, cosine: float, rows: int, recall: float, seed: int):
        rng, dim = np.random.default_rng(seed), x.shape[1]
        self.bits = min(max(math.ceil(math.log2(max(rows, 2))), KEY_BITS[0]), KEY_BITS[1])
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(other, axis=1, keepdims=True)
        far = x * cosine + math.sqrt(1 - cosine * cosine) * other / np.where(size > 0, size, 1)
        self.matrix, self.cut = np.zeros((dim, 0)), np.zeros(0)
        missed, places = 1.0, thinned(x, cosine)
        while missed > 1 - recall and self.matrix.shape[1] < 64 * BITS:
            m, t = rotation(places, rng)
            self.matrix, self.cut = np.hstack([self.matrix, m]), np.concatenate([self.cut, t])
            self.tables = self.matrix.shape[1] // self.bits
            if self.tables:
                a, b = self.keys(x), self.keys(far)
                hit = np.logical_or.accumulate(a == b, axis=1).mean(axis=0)
                missed = 1 - hit[-1]
        enough = np.flatnonzero(hit >= recall)
        self.tables = int(enough[0]) + 1 if len(enough) else self.tables
        self.matrix, self.cut = self.matrix[:, : self.tables * self.bits], self.cut[: self.tables * self.bits]
        apart = np.bitwise_count((a ^ b)[:, : self.tables].view(np.uint64)).sum(axis=1)
        self.apart = int(np.quantile(apart, PASS, method="higher"))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Table and bits of each vector's keys; equal tables' numbers leave no trace in the distance of two keys."""
        n = self.tables * self.bits
        on = (x @ self.matrix[:, :n] > self.cut[:n]).reshape(len(x), self.tables, self.bits)
        code = (on.astype(np.int64) << np.arange(self.bits)).sum(axis=2)
        return code + (np.arange(self.tables, dtype=np.int64) << self.bits)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, k1, k2) of each row, the keys of its vector, null if it takes no part; and the distinct vectors."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    takes_part = F.col("vec_id").isNotNull() & F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.select("vec_id", F.when(takes_part, F.col("v")).alias("v"))
    sizes = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    usual = F.size("v") == (sizes[0]["d"] if sizes else -1)
    rows = rows.select("vec_id", "v", F.when(usual, F.xxhash64("v")).alias("k1"), F.when(usual, F.xxhash64(F.lit(SEED), "v")).alias("k2"))
    same = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2")
    same = same.agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return materialise(rows.drop("v")), materialise(same.withColumn("node", F.monotonically_increasing_id()))


def _coded(classes: DataFrame, tables: Tables) -> DataFrame:
    """(node, copies, u, keys): unit vectors and keys."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(_matrix(b.column("v")))
                cols = [b.column("node"), b.column("copies"), _lists(u), _lists(tables.keys(u))]
                yield pa.RecordBatch.from_arrays(cols, ["node", "copies", "u", "keys"])

    rows = classes.select("node", "copies", "v")
    return materialise(rows.mapInArrow(code, "node long, copies long, u array<double>, keys array<long>"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost or too large
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(pairs: DataFrame, coded: DataFrame, n: int) -> DataFrame:
    """(node, of, u, angle) of pairs (node, of); very many may have the same `of`."""
    vectors = coded.select(F.col("node").alias("of"), F.col("u").alias("w"))
    right = pairs.groupBy("of").agg(F.count("*").alias("k")).join(vectors, "of")
    both = lookup(pairs.join(coded.select("node", "u"), "node"), right, ["of"], "k", n)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dot = np.einsum("ij,ij->i", _matrix(b.column("u")), _matrix(b.column("w")))
                cols = [b.column("node"), b.column("of"), b.column("u"), pa.array(np.arccos(np.clip(dot, -1, 1)))]
                yield pa.RecordBatch.from_arrays(cols, ["node", "of", "u", "angle"])

    return both.select("node", "of", "u", "w").mapInArrow(measure, "node long, of long, u array<double>, angle double")


def _cells(coded: DataFrame, widest: float, dense: int) -> DataFrame:
    """(node, cell, angle): the nodes at dense places, the node that leads their cell, and the angle between them."""
    open_ = materialise(coded.select("node", F.explode("keys").alias("key")))
    found, turn = [], 0
    while True:
        leader = F.min_by("node", F.xxhash64("node", F.lit(turn)))
        hot = open_.groupBy("key").agg(F.count("*").alias("k"), leader.alias("of")).filter(F.col("k") > dense)
        hot, seen = _written(hot, rows=F.sum("k"))
        if not seen.get("n"):
            discard(open_, hot)
            break
        pairs = materialise(lookup(open_, hot, ["key"], "k", open_.count()).select("node", "of").distinct())
        near = materialise(_angles(pairs, coded, seen["rows"]).drop("u"))
        # The first of the leaders that are near, so members of one group come together; of all, the nearest.
        first = F.min_by(F.struct("of", "angle"), F.xxhash64("of", F.lit(turn)))
        taken = near.filter(F.col("angle") <= widest).groupBy("node").agg(first.alias("c"))
        all_ = near.groupBy("node").agg(F.min_by(F.struct("of", "angle"), F.struct("angle", "of")).alias("c"))
        taken, got = _written(taken.select("node", F.col("c.of").alias("cell"), F.col("c.angle").alias("angle")))
        if got.get("n", 0) < WORTH * all_.count():
            discard(taken)
            taken = materialise(all_.select("node", F.col("c.of").alias("cell"), F.col("c.angle").alias("angle")))
        found.append(taken)
        before, open_ = open_, materialise(open_.join(taken, "node", "left_anti"))
        discard(before, hot, pairs, near)
        turn += 1
    if not found:
        return coded.sparkSession.createDataFrame([], "node long, cell long, angle double")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    out = materialise(out)
    discard(*found)
    return out


def _grown(coded: DataFrame, cells: DataFrame, widest: float) -> DataFrame:
    """The cells with the single nodes that share a key with a member and are near the leader, each in its nearest one."""
    keys = coded.select("node", F.explode("keys").alias("key"))
    held = keys.join(cells, "node").select("key", F.col("cell").alias("of")).distinct()
    pairs = materialise(keys.join(cells, "node", "left_anti").join(held, "key").select("node", "of").distinct())
    near = _angles(pairs, coded, pairs.count()).filter(F.col("angle") <= widest).groupBy("node")
    near = near.agg(F.min_by(F.struct("of", "angle"), F.struct("angle", "of")).alias("c"))
    out = materialise(cells.union(near.select("node", "c.of", "c.angle")))
    discard(pairs, cells)
    return out


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y, of length 1, have that cosine; what rounding could turn is added up exactly."""
    near = x @ y.T
    out = near >= cosine
    for i, j in zip(*np.nonzero(np.abs(near - cosine) < 1e-12)):
        out[i, j] = math.fsum(x[i] * y[j]) >= cosine
    return out


def _representatives(on: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that links reach from each of a and b within a block."""
    big = np.iinfo(np.int64).max
    low_a, low_b = a.copy(), b.copy()
    while True:
        new_a = np.minimum(low_a, np.where(on, low_b, big).min(axis=1, initial=big))
        new_b = np.minimum(low_b, np.where(on, new_a[:, None], big).min(axis=0, initial=big))
        if (new_a == low_a).all() and (new_b == low_b).all():
            return low_a, low_b
        low_a, low_b = new_a, new_b


def _compared(coded: DataFrame, cells: DataFrame, asks: DataFrame, cosine: float, block: int) -> DataFrame:
    """(node, n, to): how many vectors of a block each node is linked with, and the smallest node reached.

    asks: (node, of, own, u) which nodes are compared with the members of which cells; own: their own cell.
    """
    half = math.acos(cosine) / 2 - _MARGIN

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / block).cast("int")

    def one(salt: int, n: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), blocks(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(n) - 1))

    asking = asks.groupBy("of").agg(F.count("*").alias("n_asks"))
    held = cells.groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("n_held"))
    sizes = materialise(asking.join(held, "of"))
    n_asks, n_held = asks.count(), cells.count()
    members = lookup(cells.withColumnRenamed("cell", "of"), sizes, ["of"], "n_held", n_held)
    members = members.withColumn("i", one(1, "n_held")).withColumn("j", every("n_asks"))
    members = members.join(coded.select("node", "copies", "u"), "node")
    outer = F.col("angle") > half
    members = members.select("of", "i", "j", "node", "copies", "u", F.lit(False).alias("asks"), outer.alias("own"))
    askers = lookup(asks, sizes, ["of"], "n_asks", n_asks).withColumn("j", one(2, "n_asks")).withColumn("i", every("n_held"))
    askers = askers.join(coded.select("node", "copies"), "node").select("of", "i", "j", "node", "copies", "u", F.lit(True).alias("asks"), "own")

    def compare(part: pa.Table) -> pa.Table:
        flag = part.column("asks").to_numpy()
        node, copies, own = (part.column(c).to_numpy() for c in ("node", "copies", "own"))
        u = _matrix(part.column("u").combine_chunks())
        on = linked(u[flag], u[~flag], cosine) & (node[flag][:, None] != node[~flag])
        to_a, to_b = _representatives(on, node[flag], node[~flag])
        n_a = on @ copies[~flag]
        # A member that asks its own cell has counted there already.
        n_b = copies[flag] @ (on & ~(own[flag][:, None] & own[~flag]))
        return pa.table({
            "node": np.concatenate([node[flag], node[~flag]]), "n": np.concatenate([n_a, n_b]).astype(np.int64),
            "to": np.concatenate([to_a, to_b]),
        })

    return members.unionByName(askers).groupBy("of", "i", "j").applyInArrow(compare, "node long, n long, to long")


def _pairs(coded: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b), a < b: units that share a key."""
    keys = coded.select("node", F.explode("keys").alias("key")).join(units.select("node", "unit"), "node")
    keys = materialise(keys.select("key", "unit").distinct())
    x, y = keys.select("key", F.col("unit").alias("a")), keys.select("key", F.col("unit").alias("b"))
    return materialise(x.join(y, "key").filter("a < b").select("a", "b").distinct())


def _single_links(pairs: DataFrame, coded: DataFrame, cosine: float, apart: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked."""

    def side(x: str, column: str) -> DataFrame:
        return coded.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}"))

    distance = F.aggregate(
        F.zip_with("keys_a", "keys_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d
    )
    close = pairs.join(side("a", "keys"), "a").join(side("b", "keys"), "b").filter(distance <= apart).select("a", "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column("u_a")), _matrix(b.column("u_b"))
                dot = np.einsum("ij,ij->i", x, y)
                on = dot >= cosine
                for k in np.flatnonzero(np.abs(dot - cosine) < 1e-12):
                    on[k] = math.fsum(x[k] * y[k]) >= cosine
                yield b.select(["a", "b"]).filter(pa.array(on))

    both = close.join(side("a", "u"), "a").join(side("b", "u"), "b")
    return materialise(both.select("a", "b", "u_a", "u_b").mapInArrow(test, "a long, b long"))


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, dense: int = DENSE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of `vectors`."""
    rows, classes = _classes(vectors)
    n_classes = classes.count()
    if not n_classes:
        return _result(rows.select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id")))
    learn = classes.orderBy(F.xxhash64("k1", F.lit(SEED)), "k2").limit(sample).select("v").toArrow()
    tables = Tables(unit(_matrix(learn.column("v").combine_chunks())), cosine, n_classes, recall, SEED)
    coded = _coded(classes, tables)
    widest = math.acos(cosine)
    cells = _grown(coded, _cells(coded, widest, dense), widest)
    units = coded.select("node", "copies").join(cells, "node", "left").withColumn("unit", F.coalesce("cell", "node"))
    units = materialise(units)

    pairs = _pairs(coded, units)
    reach = materialise(cells.groupBy(F.col("cell").alias("of")).agg(F.max("angle").alias("reach"), F.count("*").alias("k")))
    of_a, of_b = reach.select(F.col("of").alias("a"), F.lit(True).alias("cell_a")), reach.select(F.col("of").alias("b"), F.lit(True).alias("cell_b"))
    marked = materialise(pairs.join(of_a, "a", "left").join(of_b, "b", "left"))
    links = _single_links(marked.filter("cell_a IS NULL AND cell_b IS NULL").select("a", "b"), coded, cosine, tables.apart)

    # Nodes of the other unit ask a cell; of two cells, the members of the first.
    of = F.when(F.col("cell_b"), F.col("b")).otherwise(F.col("a")).alias("of")
    by = F.when(F.col("cell_b"), F.col("a")).otherwise(F.col("b")).alias("unit")
    wanted = marked.filter("cell_a OR cell_b").select(by, of)
    sizes = units.groupBy("unit").agg(F.count("*").alias("k"))
    asked = wanted.groupBy("unit").agg(F.collect_set("of").alias("of")).join(sizes, "unit")
    near = lookup(units.select("node", "unit"), asked, ["unit"], "k", n_classes).select("node", F.explode("of").alias("of"))
    near = materialise(near)
    near = _angles(near, coded, near.count()).join(reach.select("of", "reach"), "of")
    near = near.filter(F.col("angle") <= F.col("reach") + widest + _MARGIN).select("node", "of", F.lit(False).alias("own"), "u")
    half = widest / 2 - _MARGIN
    outer = cells.filter(F.col("angle") > half).join(coded.select("node", "u"), "node")
    asks = materialise(near.union(outer.select("node", F.col("cell").alias("of"), F.lit(True), "u")))
    blocks = materialise(_compared(coded, cells, asks, cosine, block))

    # The core of a cell: all linked with each other and with the leader.
    core = units.filter(F.col("angle") <= half)
    whole = core.groupBy("unit").agg(F.sum("copies").alias("whole"), F.count("*").alias("k"))
    counts = lookup(core, whole, ["unit"], "k", n_classes).select("node", (F.col("whole") - F.col("copies")).alias("n"))
    counts = counts.union(units.select("node", F.col("copies") - 1)).union(blocks.select("node", "n"))
    weigh = units.select(F.col("node").alias("_node"), "copies")
    for x, y in ("ab", "ba"):
        counts = counts.union(links.join(weigh, F.col(y) == F.col("_node")).select(x, "copies"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n_links"))

    edges = links.union(blocks.filter("to <> node").select("to", "node"))
    edges = edges.union(core.filter("unit <> node").select("unit", "node"))
    parts = components(edges)
    low = classes.select("node", "low")
    named = low.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    first = named.groupBy("part").agg(F.min("low").alias("component_id"), F.count("*").alias("k"))
    placed = lookup(named.select("node", "part"), first, ["part"], "k", n_classes).join(counts, "node")
    ends = materialise(classes.select("node", "k1", "k2", "copies").join(placed.select("node", "component_id", "n_links"), "node"))
    discard(coded, cells, units, pairs, marked, reach, links, asks, blocks, parts, classes)

    here = lookup(rows.filter("k1 IS NOT NULL"), ends.drop("node"), ["k1", "k2"], "copies", n_classes)
    rest = rows.filter("k1 IS NULL").select("vec_id", F.lit(0), "vec_id")
    return _result(here.select("vec_id", "n_links", "component_id").union(rest))


def _result(rows: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept)


def oracle() -> str:
    """DuckDB SQL of the definition, all pairs."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {COSINE}
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, min(seen) AS component_id, e.vec_id = min(seen) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN reach ON reach.node = e.vec_id GROUP BY e.vec_id, n.n"""
