"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, at least 24 words and three periods long, that no neighbouring word
extends. Each document is handled whole, by itself, in five steps; the suffix tree is held as a suffix array with names
for all stretches of 2^k words, so any two stretches are compared, forwards or backwards, in logarithmic time.

1. Names and the suffix array, by doubling; only positions whose names are still shared are sorted again.
2. Lempel-Ziv blocks: each is the longest stretch that also starts earlier (overlaps allowed), or one new word.
3. A stretch whose leftmost occurrence is periodic crosses a block's boundary. So for each boundary b the pairs
   (b, b + k), with k up to the length of this block and the next, and (b - k, b), with k up to the length of the block
   before, are extended both ways: this gives the squares that cover all leftmost ones, here those of enough periods.
4. The vocabulary: from the place of each covering repeat in the suffix tree a walk of suffix links takes off the first
   word and adds the next one, through all rotations of its period.
5. All occurrences of each entry are the interval of suffixes below its place. Occurrences of one period at consecutive
   positions merge into one run.

Work and memory grow with the words of a text (times the logarithm of its longest repeat), whatever repeats in it; small
texts are handled many at a time.

Defined results: null, empty and white-space texts have no words and no runs; texts without runs keep all words; very
long texts are handled whole, one at a time; ties between runs go to the smallest start, then period; repeated rows
each have their row; a null id is as any other (the rewriting of `planted` leaves it alone); an empty table gives no
rows; other columns are not read, whatever their names.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import slices

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3

Rewrite = Callable[[int | None, int], np.ndarray | None]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The numbers of the words that stand in place of a document's n words: every tenth document, by its id's CRC,
    repeats a stretch from some word on. None: all stay."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


class SuffixTree:
    """The suffixes of several documents, written one after the other, in order, and names of their stretches."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray):
        """codes: a number for each word, equal for equal words; doc: a number for each word's document, not falling."""
        n = self.n = len(codes)
        key = doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank = np.empty(n + 1, np.int32)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[n] = -1
        #: names[k][i] is the same for equal stretches of 2^k words from i on, and as a rank in the order of the suffixes.
        self.names = [rank]
        last = np.concatenate([np.flatnonzero(doc[1:] != doc[:-1]) + 1, [n]])
        end = np.repeat(last, np.diff(np.concatenate([[0], last])))
        open_ = order[~(new & np.append(new[1:], True))]
        reach = 1
        while len(open_):
            beyond = open_ + reach
            second = np.where(beyond < end[open_], rank[np.minimum(beyond, n)], -1).astype(np.int64)
            key = rank[open_].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = rank[open_]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            base = np.flatnonzero(first)[np.cumsum(first) - 1]
            sub = np.flatnonzero(new)[np.cumsum(new) - 1]
            refined = rank.copy()
            refined[open_] = group + (sub - base)
            rank = refined
            self.names.append(rank)
            open_ = open_[~(new & np.append(new[1:], True))]
            reach *= 2
        self.rank = rank[:n]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self.end = end

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on; i <> j."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            name = self.names[k]
            n += (name[np.minimum(i + n, self.n)] == name[np.minimum(j + n, self.n)]).astype(np.int64) << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words up to i and up to j, both counted; i < j in one document."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            name, a = self.names[k], i - n - (1 << k) + 1
            b = a + (j - i)
            n += ((a >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << k
        return n

    def same(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the stretches of m words from i and from j on are equal (those from i lie in their document)."""
        k = np.minimum(np.frexp(m.astype(float))[1] - 1, len(self.names) - 1)
        out = i == j
        for level in np.unique(k):
            x = np.flatnonzero(k == level)
            name, tail = self.names[level], m[x] - (1 << int(level))
            a, b = i[x], j[x]
            inside = b + m[x] <= self.n
            out[x] |= inside & (name[a] == name[b]) & (name[a + tail] == name[np.minimum(b + tail, self.n)])
        return out

    def interval(self, i: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes below the place of each stretch of m words from i on: [lo, hi) in their order."""
        ends = []
        for side in (-1, 1):
            near = self.rank[i].astype(np.int64)
            far = np.full(len(i), -1 if side < 0 else self.n)
            while (open_ := np.abs(far - near) > 1).any():
                mid = (near + far) // 2
                equal = open_ & self.same(i, self.order[np.clip(mid, 0, self.n - 1)], m)
                near, far = np.where(equal, mid, near), np.where(open_ & ~equal, mid, far)
            ends.append(near)
        return ends[0], ends[1] + 1

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks start."""
        n = self.n
        left, right = [n, *range(n)], [*range(1, n + 1), 0]
        for r in reversed(self.rank.tolist()):  # suffixes leave from the last word on, so neighbours start earlier
            a, b = left[r], right[r]
            right[a], left[b] = b, a
        order = np.append(self.order, n)
        here = np.arange(n)
        longest = np.ones(n, np.int64)
        for near in (left, right):
            np.maximum(longest, self.forward(here, order[np.array(near[:n], np.int64)[self.rank]]), out=longest)
        step, starts, at = longest.tolist(), [], 0
        while at < n:
            starts.append(at)
            at += step[at]
        return np.array(starts, np.int64)


def _counting(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): for each row the numbers from `first` on, so many as `count` says."""
    row = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return row, first[row] + np.arange(len(row)) - np.repeat(ends - count, count)


def covering_repeats(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of the repeats, long enough, that cross a block's boundary."""
    b = tree.blocks()
    after = np.append(b[1:], tree.n)
    size = after - b
    head = np.concatenate([[True], tree.end[b[1:]] != tree.end[b[1:] - 1]])
    follows = np.append(~head[1:], False)
    row, k = _counting(np.ones(len(b), np.int64), size + np.where(follows, np.append(size[1:], 0), 0))
    i, j = b[row], b[row] + k
    row, k = _counting(np.ones(len(b), np.int64), np.where(head, 0, np.concatenate([[0], size[:-1]])))
    i, j = np.concatenate([i, b[row] - k]), np.concatenate([j, b[row]])
    name = tree.names[0]
    hit = name[i] == name[np.minimum(j, tree.n)]  # names tell documents apart
    i, j = i[hit], j[hit]
    k, after = j - i, tree.forward(i, j)
    inner = i > 0
    before = np.where(inner, tree.backward(np.maximum(i - 1, 0), np.maximum(j - 1, 1)), 0)
    long = before + after + k >= np.maximum(LEAST_WORDS, LEAST_PERIODS * k)
    lo, hi, k = (i - before)[long], (j + after)[long], k[long]
    by = np.lexsort((k, hi, lo))
    lo, hi, k = lo[by], hi[by], k[by]
    first = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[: len(lo)]
    return lo[first], hi[first], k[first]


def all_runs(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period."""
    lo, hi, q = covering_repeats(tree)
    m = np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    # Suffix links from each repeat's place through the rotations that it holds.
    row, place = _counting(lo, np.minimum(q, hi - lo - m + 1))
    period, m = q[row], m[row]
    low, high = tree.interval(place, m)
    entry = np.unique(np.stack([low, high, period]), axis=1)
    row, suffix = _counting(entry[0], entry[1] - entry[0])
    found = np.unique(entry[2][row] * (tree.n + 1) + tree.order[suffix])
    period, at = found // (tree.n + 1), found % (tree.n + 1)
    first = np.concatenate([[True], found[1:] != found[:-1] + 1])[: len(found)]
    last = np.append(first[1:], True)[: len(found)]
    start, period = at[first], period[first]
    end = at[last] + np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _read(b: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs: [(start, length, period)]."""
    texts = []
    for d, x in zip(b.column("doc_id"), b.column("text")):
        words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
        at = rewrite(d.as_py(), len(words)) if rewrite else None
        texts.append(words if at is None else [words[k] for k in at.tolist()])
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = pa.array([x for w in texts for x in w], pa.binary()).dictionary_encode()
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(flat):
        doc = np.repeat(np.arange(len(texts)), sizes)
        before = np.cumsum(sizes) - sizes
        for lo, hi, q in zip(*(x.tolist() for x in all_runs(SuffixTree(flat.indices.to_numpy().astype(np.int64), doc)))):
            d = int(doc[lo])
            runs[d].append((lo - int(before[d]), hi - lo, q))
    yield from zip(texts, runs)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run only the first period stays."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, start, length, period): all runs of each row of `docs`, in words."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [r for _, r in _read(b, rewrite)]
            row = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 3)
            cols = [pa.array(np.ascontiguousarray(c)) for c in flat.T]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), *cols], ["doc_id", "start", "length", "period"])

    return _named(docs).mapInArrow(runs, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, text): the texts, of each run only its first period kept; words are joined by single spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [b" ".join(_kept(w, r)).decode("utf-8", "surrogatepass") for w, r in _read(b, rewrite)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _named(docs).mapInArrow(cut, "doc_id long, text string")


_DIGEST = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def run_digests(docs: DataFrame, rewrite: Rewrite | None = planted) -> DataFrame:
    """One row for each row of `docs`: how many runs, the one of most periods, and digests of all and of what is left."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for words, runs in _read(b, rewrite):
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
                listed = "".join("%d,%d,%d\n" % r for r in runs).encode()
                rows.append((
                    len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(_kept(words, runs))).hexdigest(),
                ))
            cols = zip(*rows) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            out = [pa.array(list(c), t) for c, t in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out], [x.split()[0] for x in _DIGEST.split(", ")])

    return _named(docs).mapInArrow(digest, _DIGEST)
