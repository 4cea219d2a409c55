import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import chat, mixing, sharding
from tests.llm.conftest import DOC, prose


def test_shards_fit_and_hold_every_row(clashing, no_docs):
    rows = sharding.shards(clashing, 2_000).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode())) for r in clashing.collect())
    assert Counter((r["doc_id"], r["n_bytes"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[(r["shard_id"], r["chain"])].append(r)
    for group in held.values():
        total = sum(r["n_bytes"] for r in group)
        assert {r["shard_bytes"] for r in group} == {total}
        assert total <= 2_000 or sum(r["n_bytes"] > 0 for r in group) == 1
    assert sharding.shards(no_docs).collect() == []


def test_only_large_buckets_split(spark):
    docs = spark.createDataFrame([(k, prose(k, 20)) for k in range(400)], "doc_id long, text string")
    rows = sharding.shards(docs, 3_000).collect()
    size = {r["doc_id"]: r["n_bytes"] for r in rows}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    bits = {d: format(int(hashlib.md5(f"{d}|{text[d]}".encode()).hexdigest()[:8], 16), "032b") for d in size}
    first = min(r["depth"] for r in rows)
    for r in rows:
        mine = bits[r["doc_id"]][: r["depth"]]
        assert r["shard_id"] == int("1" + mine, 2)
        if r["depth"] > first:
            assert sum(size[d] for d in size if bits[d].startswith(mine[:-1])) > 3_000


def test_rows_alike_go_to_chains(spark):
    docs = spark.createDataFrame([(1, "x" * 100)] * 250 + [(2, "y" * 50)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["chain"]) for r in sharding.shards(docs, 1_000).collect())
    assert got == {(1, k): 10 for k in range(25)} | {(2, 0): 1}


def test_written_shards_hold_the_table(clashing, tmp_path):
    sharding.write_shards(clashing, str(tmp_path / "out"), 2_000)
    assert clashing.sparkSession.read.parquet(str(tmp_path / "out")).count() == clashing.count()


def test_written_shards_are_those_computed(spark, tmp_path):
    rows = [(None, prose(k, 20)) for k in range(150)] + [(7, prose(1000 + k, 20)) for k in range(150)] + [(8, "x" * 100)] * 95
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), 2_000)
    written = spark.read.parquet(str(tmp_path / "out"))
    held = written.groupBy("shard_id", "chain").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    assert all(r["b"] <= 2_000 for r in held)
    want = sharding.shards(docs, 2_000).groupBy("shard_id", "chain").count().collect()
    assert Counter((r["shard_id"], r["chain"], r["n"]) for r in held) == Counter(tuple(r) for r in want)
    assert Counter(map(tuple, written.select("doc_id", "text").collect())) == Counter(rows)


def test_limit_holds_under_collisions(spark, monkeypatch):
    """Few hash bits, so different documents share a hash value; some repeat, one is above the limit."""
    monkeypatch.setattr(sharding, "BITS", 4)
    rows = [(k, prose(k, 5 + k % 30)) for k in range(600)] + [(7, prose(7, 12))] * 60 + [(9, "z" * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shards(docs, 2_000).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((d, len(t)) for d, t in rows)
    held = defaultdict(list)
    for r in got:
        held[(r["shard_id"], r["chain"])].append(r)
    for group in held.values():
        assert {r["shard_bytes"] for r in group} == {sum(r["n_bytes"] for r in group)}
        assert sum(r["n_bytes"] for r in group) <= 2_000 or len(group) == 1


def test_directory_grows_from_one_bucket(spark):
    docs = spark.createDataFrame([(k, "x" * 10) for k in range(50)], "doc_id long, text string")
    assert {(r["shard_id"], r["depth"]) for r in sharding.shards(docs, 500).collect()} == {(1, 0)}
    got = sharding.shards(docs, 499).collect()
    assert {r["depth"] for r in got} == {1} and {r["shard_id"] for r in got} == {2, 3}


def test_written_shards_keep_columns_of_the_folders_names(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 20), "a", k, "c") for k in range(60)], "doc_id long, text string, shard_id string, chain int, _id string")
    sharding.write_shards(docs, str(tmp_path / "out"), 2_000)
    got = spark.read.parquet(str(tmp_path / "out")).select(*docs.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))


TURNS = "conv_id long, turn long, role string, text string"


def brute_chats(rows):
    logs = defaultdict(set)
    for k, (c, *turn) in enumerate(rows):
        logs[c if c is not None else (k,)].add(tuple(turn))
    null_first = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    lists = {c: tuple((r, x) for _, r, x in sorted(v, key=null_first)) for c, v in logs.items()}
    out = {}
    for c, a in lists.items():
        if not any(len(b) > len(a) and b[: len(a)] == a for b in lists.values()):
            same = [k for k, b in lists.items() if b == a]
            first = min((k for k in same if not isinstance(k, tuple)), default=None)
            text = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in a)
            out[(first, len(a), len(same), text)] = 1
    return Counter(out)


def test_prefixes_collapse(spark):
    r, rows = random.Random(5), []
    for c in range(120):
        base, n = r.randrange(6), r.randint(1, 7)
        rows += [(c, 3 * k, "user" if k % 2 == 0 else "assistant", f"{base if k < 4 else r.randrange(2)} {k}") for k in range(n)]
    rows += [(200, 0, None, None), (201, 0, None, ""), (202, None, "user", "0 0"), (None, 0, "user", "solo"), (None, 5, "user", "solo"), (None, 0, "user", "0 0"), (None, 0, None, None), (None, 1, "user", "t"), (203, 0, "user", "a"), (203, 0, "user", "a"), (203, 0, "user", "b")]
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(1) for n in ("pos", "h1", "n_turns")})
    got = Counter(tuple(r) for r in chat.maximal_conversations(df).select("conv_id", "n_turns", "n_copies", "text").collect())
    assert got == brute_chats(rows)
    assert chat.maximal_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_very_long_turns_and_many_copies(spark):
    rows = [(c, k, "user", "x" * 200_000 + str(k)) for c in range(3) for k in range(c + 1)] + [(9, k, "user", f"t{k}") for k in range(300)] + [(10, k, "user", f"t{k}") for k in range(299)]
    got = Counter(tuple(r) for r in chat.maximal_conversations(spark.createDataFrame(rows, TURNS)).select("conv_id", "n_turns", "n_copies", "text").collect())
    assert got == brute_chats(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 7)) == list(range(n))


def test_targets_stop_at_the_cap():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75.0, 37.5])
    got = mixing.targets([10, 100, 1000], [5, 2, 1])
    assert got == pytest.approx([30.0, 300.0, 780.0])
    assert mixing.targets([0, 50], [5, 2]) == [0.0, 50.0] and mixing.targets([], []) == []


def test_draws_add_up():
    slots = [500, 3, 0, 120]
    drawn = np.array(mixing.draw(slots, 8, 1))
    assert list(drawn.sum(axis=0)) == slots and np.ptp(drawn.sum(axis=1)) <= 1


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(k, prose(k, 40 + k % 90), "en", f"s{k % 5}" if k % 6 else None, 1) for k in range(300)]
    return spark.createDataFrame(rows, DOC)


def test_mix_meets_its_targets(sources):
    rows = mixing.takes(sources, block=16).join(sources.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(by, key=lambda x: (x is None, x))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, size, goal in zip(names, sizes, mixing.targets(sizes, [5, 2, 1, 5, 2, 1])):
        assert {r["source_size"] for r in by[s]} == {size}
        assert by[s][0]["target"] == pytest.approx(goal)
        assert abs(sum(r["taken"] for r in by[s]) - goal) <= 32
    again = mixing.takes(sources.repartition(7), block=16)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mixing.takes(sources, block=16).collect()))


def test_mixed_texts_are_the_words_taken(sources, clashing, no_docs):
    for docs in (sources, clashing):
        taken = Counter()
        for r in mixing.takes(docs, block=16).collect():
            taken[r["doc_id"]] += r["taken"]
        out = mixing.mixed_documents(docs, block=16)
        assert out.columns == docs.columns
        words = Counter()
        for r in out.collect():
            words[r["doc_id"]] += len((r["text"] or "").encode().split())
        assert words == +taken
    assert mixing.mixed_documents(no_docs).collect() == [] and mixing.takes(no_docs).collect() == []


def test_mix_of_odd_documents(clashing):
    rows = mixing.takes(clashing).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in clashing.collect())


def test_takes_follow_from_the_slots(spark, sources):
    """Words taken of each document, counted one by one from the plan: every source's slots are numbered through its
    shards, slot j takes block permutation(j mod blocks) of its epoch, and blocks are cut from its documents in order."""
    block, seed = 16, 7
    mix = mixing.Mix(sources, block=block, seed=seed)
    rows = mix.rows.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["s"]].append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in sorted(by)]
    goals = [by[s][0]["target"] for s in sorted(by)]
    counts = mixing.slot_counts(sizes, goals, block)
    want = Counter()
    for s, (blocks, slots) in enumerate(counts):
        words = [r["off"] for r in sorted(by[s], key=lambda r: r["off"]) for _ in range(r["size"])]
        assert sorted(r["off"] for r in by[s] if r["size"]) == sorted(set(words))
        used = Counter()
        for j in range(slots):
            epoch = j // blocks
            k = int(mixing.permute(np.array([j % blocks]), blocks, seed + 1000 * s + epoch)[0])
            used[k] += 1
            want.update((s, off) for off in words[k * block : (k + 1) * block])
        assert max(used.values()) - min(used.get(k, 0) for k in range(blocks)) <= 1
    got = Counter()
    for p in mix.placements.collect():
        got[(p["s"], p["off"])] += p["hi"] - p["lo"]
    assert got == want
    drawn = mix.placements.select("shard", "slot", "s").distinct().groupBy("shard").count().collect()
    n = [r["count"] for r in drawn]
    assert max(n) - min(n) <= 1 and sum(n) == sum(k for _, k in counts)
