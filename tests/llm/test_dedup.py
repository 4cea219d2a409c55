import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftline.llm import neardup, substring
from tests.llm.conftest import DOC, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows):
    """{row: (set size, component)} by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and None not in (rows[i][0], rows[j][0]) and 100 * inter >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(groups[find(i)])
        out.append((d, len(sets[i]), c, True if d is None else d == c))
    return Counter(out)


def near(df):
    return Counter(tuple(r) for r in neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_duplicates_of_odd_documents(clashing, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    assert near(clashing) == brute_components(rows)
    assert near(no_docs) == Counter()


@pytest.mark.parametrize("edits", [3, 7, 12])
def test_large_groups_lose_no_link(spark, edits):
    """Copies of one text with random edits: whether a pair is linked differs from pair to pair."""
    r, base, rows = random.Random(edits), prose(9, 150).split(), []
    for d in range(150):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((d, " ".join(w)))
    rows += [(500 + k, prose(100 + k, 60)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == brute_components(rows)


def test_odd_sketches_estimate_similarity(spark):
    r, rows = np.random.default_rng(0), []
    for size in (8, 60, 200, 1000, 5000, 40000):
        for share in (0.5, 0.75, 0.9):
            for _ in range(20):
                k = int(np.ceil(size * share))
                e = r.integers(0, 1 << 64, size, dtype=np.uint64)
                cut = k + (size - k) // 2
                for a, b in ((e[:cut], np.concatenate([e[:k], e[cut:]])), (e, e[:k])):
                    sides = []
                    for s in (np.unique(a), np.unique(b)):
                        n, bits = neardup.odd_sketch(s)
                        sides.append((len(s), n, *map(int, bits)))
                    rows.append((size, share, *sides))
    sketch = "struct<n_shingles:long,n_samples:int," + ",".join(f"{s}:long" for s in neardup._SKETCH) + ">"
    df = spark.createDataFrame(rows, f"size long, share double, a {sketch}, b {sketch}")
    df = df.withColumn("close", neardup._close("a", "b", 75))
    assert df.filter("share >= 0.75 and not close").count() == 0
    assert df.filter("share = 0.5 and size >= 200 and close").count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 3)]
    got = dict(neardup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}}


def test_one_of_each_group_stays(clashing):
    kept = neardup.keep_one(clashing)
    assert kept.columns == clashing.columns
    want = {d for (d, _, c, k) in brute_components([(r["doc_id"], r["text"]) for r in clashing.collect()]) if k}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_texts_under_one_id_are_told_apart(spark):
    """Copies under smaller ids take only their own text along, and the links of each text of an id are tested."""
    a, b, c, near_c = prose(21, 80), prose(22, 80), prose(23, 80), prose(23, 80) + " end"
    rows = [(2, b), (9, a), (9, b), (9, c), (12, near_c), (9, a)] + [(9, prose(200 + k, 60)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == brute_components(rows)
    want = Counter([(2, b), (9, a), (9, c)] + rows[6:])
    assert Counter(tuple(r) for r in neardup.keep_one(df).collect()) == want


def test_links_of_texts_under_one_id(spark):
    """Each of 20 texts that share their smallest id has a near copy of its own."""
    rows = [(1, prose(300 + k, 80)) for k in range(20)] + [(10 + k, prose(300 + k, 80) + " end") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == brute_components(rows)
    assert Counter(tuple(r) for r in neardup.keep_one(df).collect()) == Counter(rows[:20])


def test_near_copies_beside_unlinked_documents_are_not_joined_with_themselves(spark):
    """What the index by rare shingles joins doesn't grow with the square of a component's members, nor with it alone."""
    r = np.random.default_rng(1)
    core = r.integers(0, 1 << 62, 195).tolist()
    joined = []
    for m in (400, 800):
        rows = [(k, 0, sorted(core + r.integers(0, 1 << 62, 5).tolist())) for k in range(m)]
        rows.append((m, m, sorted(core[:100] + r.integers(0, 1 << 62, 100).tolist())))
        df = spark.createDataFrame(rows, "node long, of long, set array<long>").repartition(4)
        pairs = neardup._rare_pairs(df.select("node", "of"), df.select("node", "set"), 75)
        plan = pairs.count()
        assert plan <= m  # each member with the one node that isn't in its component, at most
        joined.append(plan)
    sizes = [(k, 0) for k in range(5)] + [(9, 9)]
    entries = [(n, of, 1, h, 10, 9) for n, of in sizes for h in (1, 2)] + [(0, 0, 1, 3, 10, 9), (1, 0, 1, 3, 10, 9), (20, 20, 1, 4, 10, 2), (21, 21, 1, 4, 10, 2)]
    entries = spark.createDataFrame(entries, "node long, of long, class long, h long, n long, rest long")
    met = sorted(tuple(x)[:4] for x in neardup._met(entries, entries, lambda n, m: (n + m) * 3 / 7).collect())
    assert met == [(h, 1, a, b) for h in (1, 2) for a, b in ((0, 9), (9, 0))]


def test_spans_do_not_grow_with_repeated_rows(spark):
    text = prose(40, 120)
    schema = "doc_id long, text string"
    few, many = (spark.createDataFrame([(1, text + " " + prose(41, 60))] + [(2, text)] * n + [(None, prose(42, 50))] * n + [(3, prose(42, 50))], schema) for n in (1, 1000))
    sizes = [sorted((r.d, len(r.spans)) for r in substring.repeats(x).collect()) for x in (few, many)]
    assert sizes[0] == sizes[1]
    got = Counter(map(tuple, substring.removed(many.repartition(3)).collect()))
    once = Counter(map(tuple, substring.removed(few).collect()))
    assert {k: (n if k[0] in (1, 3) else n * 1000) for k, n in once.items()} == dict(got)


def brute_removed(rows):
    """(doc_id, words, removed, hash) window by window; equal rows are one document."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows}, key=lambda x: (x[0], x[1], __import__("zlib").crc32(x[2].encode())))
    seen, gone = set(), {}
    for key in docs:
        w, cut = WORD.findall(key[2]), set()
        for k in range(len(w) - 19):
            win = tuple(w[k : k + 20])
            if win in seen:
                cut.update(range(k, k + 20))
            seen.add(win)
        left = [x for k, x in enumerate(w) if k not in cut]
        gone[key] = (len(w), len(cut), hashlib.sha256(" ".join(left).encode()).hexdigest(), " ".join(left) if cut else None)
    return [(d, *gone[(d is not None, d or 0, t or "")]) for d, t in rows]


def passages(seed):
    r, parts = random.Random(seed), [prose(50 + k, 35) for k in range(6)]
    out = []
    for d in range(60):
        text = prose(1000 * seed + d, r.randint(0, 120)).split()
        for _ in range(r.randint(0, 3)):
            p = r.choice(parts).split()
            a, b = sorted(r.sample(range(len(p) + 1), 2))
            at = r.randint(0, len(text))
            text[at:at] = p[a:b]
        out.append((d, " ".join(text)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_go(spark, seed):
    rows = passages(seed)
    got = substring.removed(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter(x[:4] for x in brute_removed(rows))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want


@pytest.mark.parametrize("seed", range(2))
def test_phrases_are_copies_of_their_references(spark, seed):
    rows = passages(seed)
    words = {d: WORD.findall(t) for d, t in rows}
    want = {d: gone for (d, _, gone, *_) in brute_removed(rows)}
    got = {}
    for r in substring.parsed(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        n = r["hi"] - r["lo"]
        assert words[r["doc_id"]][r["lo"] : r["hi"]] == words[r["ref_doc_id"]][r["ref_lo"] : r["ref_lo"] + n]
        assert (r["ref_doc_id"], r["ref_lo"]) < (r["doc_id"], r["lo"])
        got.setdefault(r["doc_id"], []).append((r["lo"], r["hi"]))
    for d, spans in got.items():
        assert all(a[1] <= b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    assert {d: sum(hi - lo for lo, hi in s) for d, s in got.items()} == {d: n for d, n in want.items() if n}


def test_a_whole_copy_is_one_phrase(spark):
    text, other = prose(77, 3_000), prose(78, 200)
    rows = [(1, text), (2, "x y z " + text + " end"), (3, other), (4, " ".join(text.split()[500:900]) + " " + other)]
    got = substring.parsed(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "lo").collect()
    assert [tuple(r) for r in got] == [(2, 3, 3_003, 1, 0), (4, 0, 400, 1, 500), (4, 400, 600, 3, 0)]


def test_repeats_of_odd_documents(clashing, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    want = brute_removed(rows)
    got = substring.removed(clashing).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == Counter(x[:4] for x in want)
    assert substring.removed(no_docs).collect() == []
    cut = substring.without_repeats(clashing)
    assert cut.columns == clashing.columns
    texts = Counter((d, t if x is None else x) for (d, t), (*_, x) in zip(rows, want))
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == texts
    assert substring.without_repeats(no_docs).columns == DOC.replace(" long", "").replace(" string", "").split(", ")
