import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from siftline.llm import packing, token_counts
from tests.llm.conftest import prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ONE = token_counts.Counter(MODEL)
ENCODER = packing.Encoder(BPE, RANKS)
TEXT = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "é", "日", "▁", "the ", "ing", "=", "😀", "Ａ", "'s", "12"]), max_size=60).map(lambda x: "".join(x * 4))


@settings(max_examples=150, deadline=None)
@given(TEXT, st.sampled_from([(64, 40), (150, 48)]))
def test_spliced_chunks_count_as_the_whole(text, cut):
    assert ONE.count(text, *cut) == len(ONE.sp.encode(text))


@pytest.mark.parametrize("text", [prose(1, 5000), "a" * 4000, " " * 3000, "日" * 2000, "=" * 900 + "x" + "=" * 700])
def test_splicing_of_long_texts(text):
    assert ONE.count(text, 512, 64) == len(ONE.sp.encode(text))


def test_counts_of_odd_documents(clashing, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count_tokens(clashing, MODEL).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in clashing.collect()]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_counts.count_tokens(no_docs, MODEL).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | TEXT)
def test_fast_ids_are_those_of_the_library(text):
    assert ENCODER.ids(text) == ENCODER.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(12))
def test_plan_holds_every_piece_once(seed):
    r = random.Random(seed)
    sizes = Counter(r.choice([r.randint(1, 100), r.randint(30, 70), 100]) for _ in range(r.choice([3, 40, 800])))
    plan, held = packing.plan(dict(sizes), 100), Counter()
    for pattern, n in plan:
        assert sum(a * b for a, b in pattern) <= 100
        for a, b in pattern:
            held[a] += b * n
    assert held == sizes
    used, least = sum(n for _, n in plan), -(-sum(a * b for a, b in sizes.items()) // 100)
    first_fit = []
    for s in sorted(sizes.elements(), reverse=True):
        k = next((k for k, x in enumerate(first_fit) if x + s <= 100), None)
        if k is None:
            first_fit.append(s)
        else:
            first_fit[k] += s
    assert least <= used <= len(first_fit)


def brute_bins(sizes: tuple, capacity: int) -> int:
    """The fewest bins, by trying everything."""
    if not sizes:
        return 0
    best, rest = len(sizes), sizes[1:]
    for mask in range(1 << len(rest)):
        inside = [x for k, x in enumerate(rest) if mask >> k & 1]
        if sizes[0] + sum(inside) <= capacity:
            best = min(best, 1 + brute_bins(tuple(x for k, x in enumerate(rest) if not mask >> k & 1), capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_reduction_keeps_the_optimum(sizes):
    fixed, left = packing.reduce_by_dominance(dict(Counter(sizes)), 20)
    bins = sum(n for _, n in fixed)
    assert bins + brute_bins(tuple(Counter(left).elements()), 20) == brute_bins(tuple(sizes), 20)


def test_packing_of_odd_documents(clashing, no_docs):
    tk = Tokenizer.from_file(BPE)
    want = Counter()
    for r in clashing.collect():
        ids = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    rows = packing.pack(clashing, BPE, RANKS, with_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert all(len(r["ids"]) == r["length"] for r in rows)
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at in places.values():
        at.sort()
        assert [a for a, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
        assert sum(n for _, n in at) <= 1024
    assert packing.pack(no_docs, BPE, RANKS).collect() == []
