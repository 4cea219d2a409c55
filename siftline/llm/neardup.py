"""Near-duplicate documents: banded MinHash candidates, odd sketches as their filter, full sets as the proof.

1. One Arrow pass gives each text its set of 5-word shingles as a size, a 128-bit key of the whole set and the band
   keys of its MinHash samples. Texts that share a bucket with another one get an odd sketch: each of up to 4096
   MinHash samples flips one bit of a bitmap, so the bits in which two sketches differ tell how many samples do, most
   precisely where few do.
2. Texts with equal sets are one class; from here on only classes count. They are numbered in the order of their
   smallest doc_id, then their set's key, so classes whose smallest doc_id is the same stay apart.
3. Each band bucket has one class as its centre, another one each round; each class is paired with one of its centres,
   in later rounds with some, that aren't in its component yet. Pairs whose sketches can't belong to a similarity of
   0.75 go, the rest is decided on the full sets, and the links give components (star contraction). Buckets that are
   one component leave. Rounds go on while the pairs of a bucket in different components are many for each class, and
   while they find links.
4. The nodes of buckets that are still open are indexed by their rarest shingles, as few as prove that a pair of
   different components that shares none of them isn't similar enough. Components that do share one meet first, then
   those members whose sizes allow it; they are compared by sketch and decided on the full sets. So a large group is
   never joined with itself and costs a few pairs for each member and unlinked text that it may be like, a passage that
   many texts share pairs none of them, and no candidate of any bucket that could join two components goes untested.

Two texts of similarity 0.75 share no band with probability (1 - 0.75^4)^32 = 5e-6, and less above.

Defined results: null and empty texts, and those of white space, have no shingles and are linked with nothing; a row
without doc_id has no component and is kept; rows that repeat an id and a text are in the same class, each with its
row; an id that repeats with other texts has a class for each of them, and is `kept` where it is the smallest id of that
text's component; very long texts give long sets, held one at a time by a task; ties in size or similarity change
nothing, as every link counts; other columns pass through whatever their names; an empty table gives no rows. `keep_one` goes by texts, not ids: of each component one row stays, a
row of the first text (by text hash) in the component's first class.
"""

import functools
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, functions as F

from siftline.llm.common import discard, lookup, materialise, named

SHINGLE = 5
BANDS, ROWS = 32, 4
#: 64-bit words of an odd sketch, which has as many bits as a text has samples at most.
SKETCH_WORDS = 64
SKETCH_BITS = 64 * SKETCH_WORDS
#: Deviations from the expected distance of sketches at the similarity sought that a candidate may have.
DEVIATIONS = 4.5
SIMILAR_PERCENT = 75
#: Centres that a node is compared with in one round after the first; what they don't settle, later rounds and step 4 do.
CENTRES_PER_NODE = 4
#: Rounds end once no more pairs are left for each node than these.
PAIRS_PER_NODE = 2
#: Rounds also end once one leaves more than this share of the pairs that were left before it.
WORTH = 0.8
#: Sizes within this ratio are one class in the index by rare elements.
SIZE_STEP = 1.1
#: Pairs whose ids may be broadcast: at most 16 MB.
BROADCAST_PAIRS = 500_000

_MASK = (1 << 64) - 1
_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(SHINGLE)]
_FOLD = _SEED.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted. bytes.lower() and bytes.split() know ASCII only, as the words do."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    if n < 1:
        whole = sum(int(x) * int(p) for x, p in zip(h, _POWERS)) + len(h)
        return mix(np.array([whole & _MASK] if len(h) else [], np.uint64))
    s = functools.reduce(operator.add, (h[k : k + n] * _POWERS[k] for k in range(SHINGLE)))
    return np.unique(mix(s))


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set, in blocks, so a long text needs no more memory than a short one."""
    low = np.full(len(_A), _MASK, np.uint64)
    for k in range(0, len(s), _STEP):
        np.minimum(low, (s[k : k + _STEP, None] * _A + _B).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = (mix(low).reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def odd_sketch(s: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of samples of a set and the parity bitmap they leave. The samples are those of one-permutation
    MinHash: the smallest hash in each of SKETCH_BITS equal ranges, so the set, sorted as it is, has them side by side.
    """
    part = s >> np.uint64(65 - SKETCH_BITS.bit_length())
    low = s[np.concatenate([[True], part[1:] != part[:-1]])]
    at = mix(low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return len(low), np.packbits(odd).view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, key, bands = [], [], []
        for x in b.column("text"):
            s = shingles(x.as_py())
            size.append(len(s))
            key.append(set_key(s) if len(s) else None)
            if len(s):
                bands.append(band_keys(samples(s)))
        full = np.array(size) > 0
        ends = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *bands])
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("text_hash"), pa.array(size, pa.int64()), pa.array(key, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            ["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
        )


_SCHEMA = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>"
_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
_SET_SCHEMA = "node long, n_shingles long, n_samples int, " + "".join(f"{s} long, " for s in _SKETCH) + "set array<long>"


def _distance(a: str, b: str) -> Column:
    return functools.reduce(
        operator.add, (F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH)
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Odd sketch and full set (sorted hashes) of the classes asked for, from each class's first text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, filled, sketch, out = [], [], [np.zeros((0, SKETCH_WORDS), np.int64)], []
            for d, x, want in zip(b.column("node"), b.column("text"), b.column("set_key")):
                s = shingles(x.as_py())
                if len(s) and set_key(s) == want.as_py():
                    n, bits = odd_sketch(s)
                    node.append(d.as_py()), filled.append(n), sketch.append(bits[None]), out.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *out])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node, pa.int64()), pa.array(list(map(len, out)), pa.int64()), pa.array(filled, pa.int32()),
                    *(pa.array(w) for w in np.concatenate(sketch).T.copy()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["node", "n_shingles", "n_samples", *_SKETCH, "set"],
            )

    return _texts(docs).join(nodes, ["doc_id", "text_hash"]).select("node", "text", "set_key").mapInArrow(sets, _SET_SCHEMA)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    all_ = F.size("set_a") + F.size("set_b") - shared
    return both.filter(100 * shared >= percent * all_).select("a", "b")


def _of_pairs(sets: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """The sets that these pairs ask for. The ids go to all tasks if they are few, so the rest isn't shuffled for them."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return sets.join(F.broadcast(asked) if n_pairs <= BROADCAST_PAIRS else asked, "node", "left_semi")


def _written(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """The table written, with aggregates of it that the write takes along."""
    seen = Observation()
    wanted = [m.alias(k) for k, m in measures.items()]
    table = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), *wanted))
    return table, seen.get


def components(links: DataFrame) -> DataFrame:
    """(node, component), written: the smallest node that links reach from each node that has links, itself left out.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each hangs neighbours on the smallest one they
    know; rounds grow with the logarithm of the path length. Every step is an aggregation and a join on narrow rows.
    """

    def hang(e: DataFrame, both_ways: bool, n: int) -> DataFrame:
        if both_ways:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("k"))
        to = lookup(e, low.withColumn("low", F.least("a", "low")), ["a"], "k", n)  # the middle of a star has very many
        if both_ways:
            return to.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        hung = to.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        return hung.filter(F.col("a") > F.col("b")).distinct()

    mark = F.bit_xor(F.xxhash64("a", "b"))
    e, seen = _written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), x=mark)
    while seen.get("n"):
        before = e
        n = 2 * seen["n"]
        e, now = _written(hang(hang(e, True, n), False, n), x=mark)
        discard(before)
        if now == seen:
            break
        seen = now
    out = materialise(e.select(F.col("a").alias("node"), F.col("b").alias("component")))
    discard(e)
    return out


def _close(a: str, b: str, percent: int) -> Column:
    """Whether two sketches may belong to sets of that similarity.

    At similarity J two sets of n elements in all have a union of n / (1 + J), which fills M of the K ranges; the
    samples of J * M of those agree, the rest flips bits, and a bitmap of K bits with f flips differs in
    K / 2 * (1 - exp(-2 f / K)) places. The deviation was simulated: at most 34, and 0.3 + 8 % of that for few.
    """
    j, k = percent / 100, float(SKETCH_BITS)
    n_a, n_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    ranges = k * (1 - F.exp(-(n_a + n_b) / (k * (1 + j))))
    flips = F.greatest(F.col(f"{a}.n_samples") + F.col(f"{b}.n_samples") - 2 * j * ranges, F.lit(0.0))
    distance = k / 2 * (1 - F.exp(-2 / k * flips))
    slack = 1 + DEVIATIONS * F.least(F.lit(34.0), 0.3 + 0.08 * distance)
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes & (_distance(a, b) <= distance + slack)


def _merged(found: DataFrame, new: DataFrame) -> DataFrame:
    """Components after further links: only those between components count."""

    def at(side: str) -> DataFrame:
        return found.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))

    ends = new.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b")
    moved = components(ends)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    kept = found.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    out = materialise(kept.union(moved))  # what moved was a component's smallest node or had no links so far
    discard(found, new, moved)
    return out


def _rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of `nodes` (node, of) of different components whose sets may be similar enough.

    Sets of n and m elements that similar share at least o(n, m) = p (n + m) / (100 + p) of them. With the elements of
    each set ordered from the rarest to the most frequent, ties by hash, the first one that both hold is at a place
    where either set has that many left. So a set is indexed by the few elements before that place only: fewest for the
    smaller of two sets, and for the larger one by class of the smaller one's size. Elements that all sets of a group
    share come last in their order and index none of them, unless the sets are that similar.

    Near copies share their rarest elements with each other. So components meet first: what an index entry holds is taken
    once for each component, entries of a single component go, and members follow only where two components have met.
    """

    def needed(n: Column, m: Column) -> Column:
        return F.ceil((n + m) * percent / F.lit(float(100 + percent)) - 1e-9)

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / math.log(SIZE_STEP))

    rows = sets.join(nodes, "node").select("node", "of", F.size("set").alias("n"), F.explode("set").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    lists = rows.join(often, "h").groupBy("node", "of", "n").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("x"))
    # Elements of no other set come before all others; they have a place, but index nothing.
    alone = F.col("n") - F.size("x")
    lists = materialise(lists.withColumn("alone", alone).withColumn("class", size_class(F.col("n"))))

    def indexed(df: DataFrame, least: Column) -> DataFrame:
        some = F.greatest(F.col("n") - needed(F.col("n"), least) + 1 - F.col("alone"), F.lit(0)).cast("int")
        return df.select("node", "of", "n", "class", "alone", F.posexplode(F.slice("x", F.lit(1), some)).alias("i", "e")).select(
            "node", "of", "n", "class", F.col("e.h").alias("h"), (F.col("n") - F.col("alone") - F.col("i")).alias("rest")
        )

    low = F.ceil(F.col("n") * percent / 100.0 - 1e-9)
    smaller = indexed(lists, F.col("n"))
    larger = lists.withColumn("class", F.explode(F.sequence(size_class(low), F.col("class"))))
    larger = indexed(larger, F.greatest(low, F.floor(F.pow(F.lit(SIZE_STEP), "class")) - 1))
    smaller, larger = materialise(smaller), materialise(larger)
    met = _met(smaller, larger, needed)
    # Members that no set of the other component can be like, by its sizes, stay out.
    likely = (F.least("s.rest", "t.left") >= needed(F.col("s.n"), F.col("t.m"))) & (F.col("s.n") <= F.col("t.most"))
    held = functools.reduce(operator.and_, (F.col(f"s.{c}") == F.col(f"t.{c}") for c in ("h", "class", "of")))
    x = smaller.alias("s").join(met.alias("t"), held & likely).select("s.node", "s.n", "s.class", "s.h", "s.rest", F.col("t.other").alias("of")).alias("x")
    y = larger.alias("y")
    same = (F.col("x.h") == F.col("y.h")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.of") == F.col("y.of"))
    order = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))
    enough = F.least("x.rest", "y.rest") >= needed(F.col("x.n"), F.col("y.n"))
    pairs = x.join(y, same & order & enough)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _met(smaller: DataFrame, larger: DataFrame, needed: Callable[[Column, Column], Column]) -> DataFrame:
    """(h, class, of, other, m, most, left): the different components that share an index entry, only where the sizes of their
    sets, and what is left of these, allow a pair; m and most are the other one's smallest and largest size."""
    x = smaller.groupBy("h", "class", "of").agg(F.min("n").alias("n"), F.max("rest").alias("rest"))
    y = larger.groupBy("h", "class", "of").agg(F.min("n").alias("m"), F.max("n").alias("most"), F.max("rest").alias("left"))
    ends = x.select("h", "class", "of").union(y.select("h", "class", "of")).groupBy("h", "class").agg(F.min("of").alias("a"), F.max("of").alias("b"))
    several = ends.filter("a <> b").select("h", "class")
    x, y = x.join(several, ["h", "class"]).alias("x"), y.withColumnRenamed("of", "other").alias("y")
    enough = (F.least("rest", "left") >= needed(F.col("n"), F.col("m"))) & (F.col("n") <= F.col("most")) & (F.col("of") != F.col("other"))
    same = (F.col("x.h") == F.col("y.h")) & (F.col("x.class") == F.col("y.class"))
    return x.join(y, same & enough).select("x.h", "x.class", "of", "other", "m", "most", "left")


def _closure(members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the nodes that have links, from the nodes of each bucket."""
    spark = members.sparkSession
    found = spark.createDataFrame([], "node long, component long")
    tested = spark.createDataFrame([], "a long, b long")
    a, b = (sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    n_nodes, turn, before, last = sketches.count(), 0, 0.0, False
    held, written = [], []
    now = members.select("band", "node", F.col("node").alias("of"))
    while True:
        # One member of each component of a bucket; the largest component's is the centre. Rounds after the first take
        # other members in other buckets, so what is left meets many members of a large group at once.
        order = F.xxhash64("node", F.lit(turn)) if turn == 0 else F.xxhash64("node", "band", F.lit(turn))
        parts = now.groupBy("band", "of").agg(F.count("*").alias("n"), F.min_by("node", order).alias("node"))
        weight = F.struct("n", F.xxhash64("of", F.lit(turn)))
        centres = parts.groupBy("band").agg(
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("left"),
            F.max_by(F.struct("node", "of"), weight).alias("c"),
        )
        centres = centres.filter("left > 0").select("band", "left", F.col("c.node").alias("centre"), F.col("c.of").alias("of_c"))
        centres, seen = _written(centres, left=F.sum("left"))
        if not seen.get("n"):
            break
        left = seen["left"]
        last = last or (turn > 0 and left <= PAIRS_PER_NODE * n_nodes) or (turn > 1 and left > WORTH * before)
        before = left
        # Buckets whose nodes are all in one component have no say any more.
        open_ = materialise(now.join(centres, "band").select("band", "node", "of", "centre", "of_c"))
        discard(centres, *held)
        held = [open_]
        if last:
            pairs = _rare_pairs(open_.select("node", "of").distinct(), sets, percent)
        else:
            to = F.array_sort(F.collect_set(F.struct(F.xxhash64("centre", F.lit(turn)).alias("h"), "centre")))
            some = open_.filter("of <> of_c").groupBy("node").agg(to.alias("to"))
            some = some.select(F.col("node").alias("b"), F.explode(F.slice("to", 1, 1 if turn == 0 else CENTRES_PER_NODE)).alias("c"))
            pairs = some.select(F.least("b", "c.centre").alias("a"), F.greatest("b", "c.centre").alias("b")).distinct()
        if turn:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = pairs.join(b, "b").join(a, "a").filter(_close("sketch_a", "sketch_b", percent)).select("a", "b")
        pairs, tries = _written(pairs)
        written.append(pairs)
        new, got = _written(_links(pairs, _of_pairs(sets, pairs, tries.get("n", 0)), percent))
        if got.get("n"):
            found = _merged(found, new)
        discard(new)
        if last:
            break
        last = turn > 0 and not got.get("n")
        tested = tested.union(pairs)
        now = open_.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("of"))
        turn += 1
    discard(*held, *written)
    return found


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, first) of each row of `docs`; `first` tells whether its text is the
    one that stands for its component, and is null for rows that have none."""
    rows = materialise(_texts(docs).mapInArrow(_signatures, _SCHEMA))
    known = rows.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    low = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("low"), F.count("*").alias("copies"))
    low = low.select("set_key", "low.*", "copies")
    # Numbers that follow the order of the ids, so the smallest node of a component has its smallest id.
    first = materialise(low.orderBy("doc_id", "set_key").withColumn("node", F.monotonically_increasing_id()))
    classes = materialise(known.join(first.drop("copies"), ["set_key", "doc_id", "text_hash"]).select("node", "bands"))

    members = classes.select(F.explode("bands").alias("band"), "node").distinct()
    shared = members.groupBy("band").agg(F.count("*").alias("_n")).filter("_n > 1").select("band")
    members = materialise(members.join(shared, "band"))
    paired = members.select("node").distinct()
    sets = materialise(_full_sets(docs, first.drop("copies").join(paired, "node")).dropDuplicates(["node"]))
    sketches = sets.select("node", F.struct("n_shingles", "n_samples", *_SKETCH).alias("sketch"))
    found = _closure(members, sketches, sets.select("node", "set"), percent)
    discard(classes, members, sets)

    ids = first.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    moved = found.join(ids, "component").select("node", "component_id")
    ends = first.join(moved, "node", "left").select(
        "set_key", F.col("text_hash").alias("_hash"), F.col("doc_id").alias("_low"), "component_id", "copies"
    )
    # A text with very many copies is dealt over many tasks.
    classed = lookup(known.drop("bands"), ends, ["set_key"], "copies", rows.count())
    stands = F.col("component_id").isNull() & (F.col("doc_id") == F.col("_low")) & (F.col("text_hash") == F.col("_hash"))
    classed = classed.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "_low").alias("component_id"), stands.alias("first"))
    rest = rows.filter(F.col("set_key").isNull() | F.col("doc_id").isNull())
    return classed.union(rest.select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("boolean")))


def near_duplicates(docs: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs`."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _grouped(docs, percent).select("doc_id", "n_shingles", "component_id", kept)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their group, all columns as they are."""
    texts = _grouped(docs, SIMILAR_PERCENT).filter(F.col("first").isNotNull())
    # One line for each text that goes, or that stays but has several rows.
    odd = texts.groupBy(F.col("doc_id").alias("_odd_id"), F.col("text_hash").alias("_odd_hash"))
    odd = odd.agg(F.bool_or("first").alias("_odd_first"), F.count("*").alias("_odd_n"))
    odd = materialise(odd.filter("NOT _odd_first OR _odd_n > 1").drop("_odd_n"))
    # Whole rows in one column, so no column of `docs` can be taken for one of ours.
    every = named(docs.columns)
    rows = docs.select(
        F.struct(*every).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.xxhash64(*every).alias("_whole")
    )
    same = (F.col("_id") == F.col("_odd_id")) & (F.col("_hash") == F.col("_odd_hash"))
    out = rows.join(odd, same, "left_anti").select("_row")
    repeated = odd.filter("_odd_first")
    if not repeated.isEmpty():
        again = rows.join(repeated, same).groupBy("_odd_id", "_odd_hash")
        out = out.union(again.agg(F.min_by("_row", "_whole").alias("_row")).select("_row"))
    return out.select("_row.*")


def oracle() -> str:
    """DuckDB SQL of the definition: shingle sets, all pairs that share a shingle, closure by recursion."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= {SIMILAR_PERCENT} * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(seen) AS component_id, d.doc_id = min(seen) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id, n.n"""
