"""Best-fit packing of tokenised documents into sequences of fixed length.

Items of equal length are interchangeable, so the packing is found on the histogram of lengths, which has at most
`capacity` rows whatever the corpus: first the Martello-Toth reduction fixes sets of one or two items that dominate
every other way to fill their sequence, as long as there are any; best-fit decreasing then packs the rest. The
solution is a list of patterns (lengths and how many sequences hold them); each document's piece finds its place by
its running number among the pieces of its length.

Defined results: a null or empty text is one piece, the end token alone; a row of the input is a document, so repeated
ids or rows are packed as often as they occur; null ids pass through; very long texts are cut into pieces, one text at a
time; pieces of equal length are interchangeable, so which of them goes where is settled by their running number; other
columns are not read; an empty table gives no rows.
"""

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from siftline.llm.common import materialise, running_offsets, salts_for

CAPACITY = 1024
END = 2
#: Run-length pattern of a sequence: (length, how many in a row), longest first.
Pattern = list[tuple[int, int]]

_loaded: dict[tuple, "Encoder"] = {}


class Encoder:
    """Ids of a byte-level BPE as `tokenizers` gives them for its .json file.

    The same vocabulary as ranks serves an equal, several times faster encoder; a text that holds a special token's
    string, where the two differ, goes to `tokenizers` itself. Tests compare both.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int, end: int, with_ids: bool):
    """Each document's ids and an end token, cut from the end into pieces of `capacity`; the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path, ranks_path)
        for b in batches:
            doc, no, start, length, crc, kept = [], [], [], [], [], []
            for d, text in zip(b.column("doc_id").to_pylist(), (x.as_py() for x in b.column("text"))):
                ids = np.array([*(enc.ids(text) if text else ()), end], "<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    doc.append(d), no.append(k), start.append(lo), length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                    kept.append(ids[lo:hi].tolist() if with_ids else None)
            cols = [
                pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Martello-Toth reduction on a histogram: (fixed patterns with their number, what is left).

    For the longest open length j and k, the longest that fits beside it: {j, k} dominates every set with j if all
    that could stand beside j instead is one item (none is longer than k), or several whose sum is k at most. j alone
    dominates if nothing fits beside it.
    """
    left, fixed, changed = {s: n for s, n in counts.items() if n}, [], True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                others = sorted(s for s, n in left.items() if n > (s == j))
                at = bisect_left(others, room + 1)
                if not at:
                    fixed.append(([(j, 1)], left.pop(j)))
                    changed = True
                    break
                k = others[at - 1]
                if k < room and not _sums_stay_within(others[:at], k, room):
                    break
                n = left[j] // 2 if j == k else min(left[j], left[k])
                fixed.append(([(j, 2)] if j == k else [(max(j, k), 1), (min(j, k), 1)], n))
                for s in (j, k):
                    left[s] -= n
                left = {s: m for s, m in left.items() if m}
                changed = True
    return fixed, left


def _sums_stay_within(sizes: list[int], k: int, room: int) -> bool:
    """Whether no two or more of these lengths (each as often as one likes) have a sum above k that fits the room."""
    fits = (1 << room + 1) - 1
    sums = sum(1 << s for s in sizes)  # bit s: a sum of s
    for _ in range(room // sizes[0] - 1):
        longer = 0
        for s in sizes:
            longer |= sums << s & fits
        if longer >> k + 1:
            return False
        sums = longer
    return True


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram; equal sequences are held once, with their number."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in open_ if r >= s), default=capacity)
            pattern, m = open_[room].pop() if room in open_ else ([], -(-n // (capacity // s)))
            if room in open_ and not open_[room]:
                del open_[room]
            each = room // s
            full, rest = min(m, n // each), n % each
            more = min(m - full, 1) if rest else 0
            if full:
                open_.setdefault(room - each * s, []).append(([*pattern, (s, each)], full))
            if more:
                open_.setdefault(room - rest * s, []).append(([*pattern, (s, rest)], 1))
            if pattern and m - full - more:
                open_.setdefault(room, []).append((pattern, m - full - more))
            n -= full * each + more * rest
    return [x for groups in open_.values() for x in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a row, first sequence, offset) of each place in each pattern."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for s, times in pattern:
            first = ranks.get(s, 0)
            ranks[s] = first + n * times
            out.append((s, first, ranks[s], times, sequence, offset))
            offset += s * times
        sequence += n
    return out


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece and its place.

    Only the histogram (at most `capacity` rows) goes to the driver, and only the patterns' places (a few for each
    length) are broadcast. Pieces are numbered within their length by `running_offsets`, so a length that a third of
    all pieces share is dealt over many tasks.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, json_path, ranks_path, capacity, end, with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan(counts, capacity))
    schema = "_s long, _first long, _end long, _times long, _seq long, _off long"
    table = spark.createDataFrame(places, schema).coalesce(1)
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = running_offsets(cut, ["length"], F.lit(1), order, salts_for(sum(counts.values())), "_rank")
    placed = ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("_s")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")),
    )
    step = F.col("_rank") - F.col("_first")
    return placed.select(
        *cut.columns,
        (F.col("_seq") + F.floor(step / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_off") + step % F.col("_times") * F.col("length")).cast("long").alias("offset"),
    )
