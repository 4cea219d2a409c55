"""Centroid clustering, periodic runs and quantised near-duplicates against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from siftline.llm import clustering, periods, quantised

VEC = "vec_id long, embedding array<float>, label int"


def many(spark, rows):
    return spark.createDataFrame(rows, VEC).repartition(5)


# Clustering


def by_hand(rows, k=16, rounds=3):
    kept = [(i, [p * 64 // q for p, q in (float(x).as_integer_ratio() for x in v)]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, y)), n) for n, y in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        c = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else y for n, y in enumerate(c)]
    out = [(i, *place(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    within = {n: sum(d for _, d, m in out if m == n) for n in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, n, fits(d), fits(within[n]), fits(total), digest[n]) for i, d, n in out), key=repr)


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(k, [r.gauss(r.randrange(4), 1.0) for _ in range(64)], 0) for k in range(300)]
    rows += [rows[5], rows[6], (7, rows[9][1], 1), (None, rows[1][1], 1)]
    df = many(spark, rows)
    want = by_hand([(x.vec_id, x.embedding) for x in df.collect()])
    assert of(clustering.clusters(df)) == want


def test_large_components_are_counted_in_integers(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) * 10.0 ** r.choice([0, 3, 9, 17, 30]) for _ in range(64)], 0) for k in range(60)]
    rows += [(100 + k, [r.gauss(0, 1) for _ in range(64)], 0) for k in range(60)]
    df = many(spark, rows)
    want = by_hand([(x.vec_id, x.embedding) for x in df.collect()])
    assert of(clustering.clusters(df)) == want
    assert any(x[2] is None for x in want) and len({x[1] for x in want}) > 2


def test_largest_doubles_do_not_overflow(spark):
    rows = [(k, [s * 1.7e308] + [0.0] * 63) for k, s in enumerate([1, -1, 0, 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert of(clustering.clusters(df, k=2)) == by_hand(rows, k=2)


def test_odd_vectors_are_left_out(spark):
    v = [0.5] * 64
    odd = [(1, None, 0), (2, [], 0), (3, v[:63], 0), (4, v + [0.0], 0), (5, [None] + v[1:], 0), (6, [float("nan")] + v[1:], 0), (7, [float("-inf")] + v[1:], 0)]
    good = [(8, v, None), (8, v, None), (9, [0.0] * 64, 1)]
    df = many(spark, odd + good).selectExpr("*", "1 AS cluster", "2 AS v", "3 AS `a.b`")
    assert of(clustering.clusters(df)) == by_hand([(i, x) for i, x, _ in good])
    assert clustering.clusters(many(spark, odd)).count() == 0
    assert clustering.clusters(spark.createDataFrame([], VEC)).count() == 0


def test_fast_and_exact_distances_agree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 64)) * 1000
    c = [clustering.integers(v.tolist(), 64) for v in x[:5]]
    fast = clustering.assign(x, c, 64)
    slow = clustering.assign(x, [*c, [1 << 60] * 64], 64)  # one far centroid takes the fast way from all rows
    assert not fast[3] and len(slow[3]) == 50
    assert fast[0].tolist() == slow[0].tolist() and fast[1] == slow[1]


# Periodic runs


def runs_by_hand(w):
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def words_with_runs(r, n):
    w = []
    while len(w) < n:
        kind = r.randrange(4)
        if kind == 0:
            w += [r.choice("abc") for _ in range(r.randrange(1, 30))]
        elif kind == 1:
            unit, times = [r.choice("abcdefgh"[: r.randrange(1, 8)]) for _ in range(r.randrange(1, 14))], r.randrange(2, 9)
            w += (unit * times)[: len(unit) * times - r.randrange(len(unit))]
        elif kind == 2:
            w += [str(r.randrange(1000)) for _ in range(r.randrange(1, 20))]
        elif w:
            at = r.randrange(len(w))
            w += w[at : at + r.randrange(1, 80)]
    return w[:n]


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        docs = [[r.choice("ab") for _ in range(r.randrange(120))] if r.random() < 0.2 else words_with_runs(r, r.randrange(300)) for _ in range(r.randrange(1, 6))]
        flat = [x for d in docs for x in d]
        if not flat:
            continue
        code = {x: k for k, x in enumerate(sorted(set(flat)))}
        doc = np.repeat(np.arange(len(docs)), list(map(len, docs)))
        start, end, q = periods.all_runs(periods.SuffixTree(np.array([code[x] for x in flat]), doc))
        before = np.cumsum([0, *map(len, docs)])
        want = [(s + before[k], n, p) for k, d in enumerate(docs) for s, n, p in runs_by_hand(d)]
        assert sorted(zip(start, end - start, q)) == sorted(want)


def earlier(w, at):
    """The longest stretch from `at` on that also starts earlier."""
    best = 0
    for i in range(at):
        n = 0
        while at + n < len(w) and w[i + n] == w[at + n]:
            n += 1
        best = max(best, n)
    return best


def test_blocks_are_longest_earlier_stretches():
    r = random.Random(9)
    for _ in range(40):
        w = [r.choice("abc") for _ in range(r.randrange(1, 60))]
        tree = periods.SuffixTree(np.array([ord(c) for c in w]), np.zeros(len(w), np.int64))
        at, want = 0, []
        while at < len(w):
            want.append(at)
            at += max(earlier(w, at), 1)
        assert tree.blocks().tolist() == want


def test_long_repeats_stay_cheap():
    w = np.zeros(200_000, np.int64)
    assert [x.tolist() for x in periods.all_runs(periods.SuffixTree(w, w))] == [[0], [200_000], [1]]
    w = np.arange(200_000) % 50_000
    assert [x.tolist() for x in periods.all_runs(periods.SuffixTree(w, w * 0))] == [[0], [200_000], [50_000]]


def digest_by_hand(doc_id, text):
    w = (text or "").encode("utf-8", "surrogatepass").split()
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode())
    return (doc_id, len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None, listed, sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_digests_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(k, " ".join(words_with_runs(r, r.randrange(200)))) for k in range(120)]
    rows += [(k, " ".join(str(r.randrange(10**6)) for _ in range(r.randrange(150)))) for k in range(120, 240)]
    rows += [(3, None), (None, "x " * 40), (None, None), (500, ""), (501, " \t\n\x0b\f\r"), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "2 AS `a.b`", "3 AS start")
    got = sorted(map(tuple, periods.run_digests(df.repartition(4)).collect()), key=repr)
    assert got == sorted((digest_by_hand(*x) for x in rows), key=repr)
    assert sum(x[1] for x in got) > 50


def test_digests_of_odd_documents(spark, odd_docs, no_docs, clashing):
    want = sorted((digest_by_hand(x.doc_id, x.text) for x in odd_docs.collect() if len(x.text or "") < 10_000), key=repr)
    short = "coalesce(length(text), 0) < 10000"
    assert sorted(map(tuple, periods.run_digests(odd_docs.filter(short)).collect()), key=repr) == want
    assert sorted(map(tuple, periods.run_digests(clashing.filter(short)).collect()), key=repr) == want
    assert periods.run_digests(odd_docs).count() == odd_docs.count()
    assert periods.run_digests(no_docs).count() == 0


def test_collapsed_texts_have_no_run_left_of_what_was_dropped(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 20 + "y"), (2, "one two  three")], "doc_id long, text string")
    assert sorted(map(tuple, periods.collapsed(df).collect())) == [(1, "x a b c y"), (2, "one two three")]
    assert sorted(map(tuple, periods.find_runs(df).collect())) == [(1, 1, 60, 3)]


# Near-duplicate vectors


def neardup_by_hand(rows, cosine=0.95):
    def takes_part(i, v):
        return i is not None and v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    part = [takes_part(i, v) for i, v, *_ in rows]
    u = np.array([np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if p else np.zeros(64) for (_, v, *_), p in zip(rows, part)])
    on = u @ u.T >= cosine
    np.fill_diagonal(on, False)
    low = np.array([i if p else 1 << 60 for (i, *_), p in zip(rows, part)])
    while True:
        new = np.minimum(low, np.where(on, low[None, :], 1 << 62).min(axis=1))
        if (new == low).all():
            break
        low = new
    out = []
    for k, ((i, *_), p) in enumerate(zip(rows, part)):
        c = int(low[k]) if p else i
        out.append((i, int(on[k].sum()), c, i is None or c == i))
    return sorted(out, key=repr)


def groups(seed, sizes, loose):
    """Groups of near copies at random places: a centre and copies that lie about `loose` radians from it."""
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        for _ in range(n):
            d = rng.normal(size=64)
            d -= (d @ c) * c
            a = abs(rng.normal(loose, loose / 3))
            out.append((np.cos(a) * c + np.sin(a) * d / np.linalg.norm(d)).tolist())
    return out


def test_neardup_vectors_equal_brute_force(spark):
    v = groups(1, [1] * 300 + [2] * 40 + [40] * 3 + [400], 0.06)
    rows = [(k, x, 0) for k, x in enumerate(v)] + [(k, v[k], 0) for k in range(5)] + [(9000 + k, v[7], 0) for k in range(50)]
    assert of(quantised.near_duplicates(many(spark, rows))) == neardup_by_hand(rows)


def test_loose_and_unlinked_dense_places(spark):
    """Groups wider than the cosine, and one where hardly any two are linked: cells by force, products by blocks."""
    v = groups(2, [350, 1, 300], 0.17) + groups(3, [400], 0.45)
    rows = [(k, x, 0) for k, x in enumerate(v)]
    got, want = of(quantised.near_duplicates(many(spark, rows), dense=16, block=64)), neardup_by_hand(rows)
    exact = sum(a == b for a, b in zip(got, want))
    found, true = sum(x[1] for x in got), sum(x[1] for x in want)
    assert all(a[1] <= b[1] for a, b in zip(sorted(got), sorted(want)))  # never a link too many
    assert found >= 0.97 * true and exact >= 0.9 * len(want) and true > 1000


def test_recall_at_the_cosine_itself(spark):
    """Pairs barely within the cosine, the hardest to find."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rng.normal(size=x.shape)
    d -= (d * x).sum(axis=1, keepdims=True) * x
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    rows = [(k, z.tolist(), 0) for k, z in enumerate(np.concatenate([x, y]))]
    got, want = of(quantised.near_duplicates(many(spark, rows))), neardup_by_hand(rows)
    assert sum(w[1] for w in want) >= 2900
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)


def test_near_copies_are_not_paired(spark):
    """A group's rows compared grow with its members, not with their pairs."""
    v = groups(6, [2000] + [1] * 20, 0.02)
    rows = [(k, x, 0) for k, x in enumerate(v)]
    df = many(spark, rows)
    _, classes = quantised._classes(df)
    tables = quantised.Tables(np.array(v), 0.95, len(v), 0.99, 1)
    coded = quantised._coded(classes, tables)
    cells = quantised._cells(coded, np.arccos(0.95), 128)
    assert cells.count() >= 1990 and cells.select("cell").distinct().count() < 20
    units = coded.select("node").join(cells, "node", "left").selectExpr("node", "coalesce(cell, node) AS unit")
    assert quantised._pairs(coded, units).count() < 500
    assert of(quantised.near_duplicates(df)) == neardup_by_hand(rows)


def test_odd_vectors_link_with_nothing(spark):
    v = groups(7, [3, 1], 0.01)
    big = (np.array(v[0]) * 1e30).tolist()
    rows = [(1, v[0], 0), (2, v[1], None), (2, v[3], 1), (3, big, 0), (4, None, 0), (5, [], 0), (6, [0.0] * 64, 0), (7, v[0][:63], 0), (8, [None] + v[0][1:], 0), (9, [float("nan")] + v[0][1:], 0), (10, [float("inf")] + v[0][1:], 0), (None, v[0], 0), (None, None, None), (11, v[2], 0), (11, v[2], 0)]
    df = many(spark, rows).selectExpr("*", "1 AS n_links", "2 AS `a.b`", "3 AS v", "4 AS node")
    assert of(quantised.near_duplicates(df)) == neardup_by_hand(rows)
    assert quantised.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    assert of(quantised.near_duplicates(many(spark, [(4, None, 0), (6, [0.0] * 64, 0)]))) == [(4, 0, 4, True), (6, 0, 6, True)]


def test_codes_are_balanced_and_rotations_orthogonal():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64)) + 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m, cut = quantised.rotation(x, rng)
    assert np.allclose(m.T @ m, np.eye(64), atol=1e-9)
    assert np.abs((x @ m > cut).mean(axis=0) - 0.5).max() < 0.01
