"""Exact removal of repeated passages by relative Lempel-Ziv parsing.

Every window of 20 words that also starts earlier in the corpus is a repeat, and the words it covers go. A document is
parsed into phrases, each a run of words copied from a reference; what no phrase covers is new. References are not
shipped to the documents: they are indexed, and the index is joined.

1. Each window is owned by its smallest 5-word gram (the leftmost of equals), so equal windows always have equal
   owners, wherever they stand. The windows of one owner are one factor: about eight windows, one row with the
   owner's hash and a hash of all words the factor spans.
2. The index holds the first of equal factors (smallest doc_id, then position) of the whole corpus: every later equal
   factor matches it, with all its windows. Factors whose owner occurs once in the corpus match nothing.
3. Where one owner has several different references, a passage begins or ends inside them: only at these factor
   boundaries windows are looked up one by one, again against the first.
4. A document's matches against the same place of the same reference are joined into runs, and the parse goes greedily
   from left to right: where it stands, the run that reaches furthest becomes the phrase.

Copies and passages are thus settled by whole factors, and window rows exist only around the ends of passages. Every
phrase follows the first occurrence of its words; a longer match that a later occurrence would give is not looked for,
as it covers no other words.

Defined results: null, empty and short texts (under 20 words) lose nothing; within equal ids, rows are one document if
their texts are equal (each row reports it) and are ordered by the CRC of the text if not; a null id comes first; an
empty table gives no rows; very long texts are parsed whole, one at a time; other columns pass through whatever their
names. `text` of the result keeps the words that are left, joined by single spaces, if a word was
removed, and is the text as it was if not.
"""

import functools
import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import discard, lookup, materialise, named, slices
from siftline.llm.neardup import mix

WINDOW = 20
GRAM = 5
#: A factor's place is one number: the first of its windows times this, and how many they are (WINDOW - GRAM + 1 at most).
_SPAN = 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(GRAM)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


class Words:
    """Hashes of any run of words of a text, from running sums."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.n = len(self.words)
        self.h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * _power(_BASE, self.n))])

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        spans = (self.sums[hi] - self.sums[lo]) * _power(_INVERSE, self.n + 1)[lo]
        return mix(spans + (hi - lo).astype(np.uint64))

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner's hash, factor's hash, first window, windows) of each factor."""
        n = self.n - GRAM + 1
        low = mix(functools.reduce(operator.add, (self.h[k : k + n] * _GRAM_POWERS[k] for k in range(GRAM))))
        at, reach, want = np.arange(n), 1, WINDOW - GRAM + 1
        while reach < want:  # the leftmost smallest gram of 1, 2, 4, ... grams
            step = min(reach, want - reach)
            a, b = low[:-step], low[step:]
            left = a <= b
            at, low = np.where(left, at[:-step], at[step:]), np.where(left, a, b)
            reach += step
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        owner = low[first]
        place = (at[first] - first).astype(np.uint64) * np.uint64(_INVERSE)
        return owner, mix(self.runs(first, first + count + WINDOW - 1) + place), first, count

    def windows(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of the windows of some factors."""
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)
        return self.runs(at, at + WINDOW), at


def _bytes(x) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


def _join(parts: list, dtype) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, dtype), *parts]).astype(dtype))


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out: list[list] = [[], [], [], []]
        for k, x in enumerate(b.column("text")):
            w = Words(_bytes(x))
            if w.n >= WINDOW:
                owner, whole, first, count = w.factors()
                for to, part in zip(out, (np.full(len(first), k), owner.view(np.int64), whole.view(np.int64), first * _SPAN + count)):
                    to.append(part)
        row = _join(out[0], np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("d").take(row), b.column("t").take(row), *(_join(x, np.int64) for x in out[1:])],
            ["d", "t", "owner", "whole", "place"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        row, hashes, starts = [], [], []
        for k, (x, ask) in enumerate(zip(b.column("text"), b.column("asked"))):
            place = np.sort(ask.values.to_numpy())
            h, at = Words(_bytes(x)).windows(place // _SPAN, place % _SPAN)
            row.append(np.full(len(at), k)), hashes.append(h.view(np.int64)), starts.append(at)
        row = _join(row, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("d").take(row), b.column("t").take(row), _join(hashes, np.int64), _join(starts, np.int64)],
            ["d", "t", "window", "at"],
        )


def phrases(spans: pa.Array | None) -> list[tuple[int, int, int, int]]:
    """[(lo, hi, reference's d, its first word)]: the greedy parse by a document's matches, in order, without overlaps."""
    if spans is None or not len(spans):
        return []
    lo, hi, d, t, at = (spans.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi", "d", "t", "at"))
    order = np.lexsort((lo, at - lo, t, d))
    lo, hi, d, t, at = (x[order] for x in (lo, hi, d, t, at))
    other = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | ((at - lo)[1:] != (at - lo)[:-1])])
    # The furthest end so far along one reference; a match that begins beyond it begins another run.
    key = np.cumsum(other) << 40
    reach = np.maximum.accumulate(key + hi) - key
    other[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(other)
    last = np.append(first[1:], len(lo)) - 1
    runs = sorted(zip(lo[first].tolist(), reach[last].tolist(), d[first].tolist(), at[first].tolist()))
    out, pos, k = [], 0, 0
    while k < len(runs) or out:
        furthest = None
        while k < len(runs) and runs[k][0] <= pos:
            furthest = max(furthest or runs[k], runs[k], key=lambda r: r[1])
            k += 1
        if furthest and furthest[1] > pos:
            start, end, ref, first_word = furthest
            out.append((pos, end, ref, first_word + pos - start))
            pos = end
        elif k < len(runs):
            pos = runs[k][0]
        else:
            break
    return out


def strip(words: list[bytes], parse: list[tuple[int, int, int, int]]) -> list[bytes]:
    """The words outside all phrases."""
    kept, at = [], 0
    for lo, hi, *_ in parse:
        kept += words[at:lo]
        at = hi
    return kept + words[at:]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n, gone, sha = [], [], []
        for x, spans in zip(b.column("text"), b.column("spans")):
            words = _bytes(x).split()
            kept = strip(words, phrases(spans.values))
            n.append(len(words)), gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _key(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """d and t name a document: its id (null first), and the CRC of its text for ids that repeat, then 30 bits of another
    hash, as many rows may have no id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.crc32(text.cast("binary")) * (1 << 30) + F.xxhash64(text).bitwiseAND((1 << 30) - 1)
    return docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), tie.alias("t"))


def _once(texts: DataFrame) -> DataFrame:
    """Each document once, however many rows repeat it; texts move only where some do."""
    again = materialise(texts.groupBy("d", "t").agg(F.count("*").alias("k")).filter("k > 1").select("d", "t"))
    if again.isEmpty():
        return texts
    return texts.join(again, ["d", "t"], "left_anti").unionByName(texts.join(again, ["d", "t"]).dropDuplicates(["d", "t"]))


def repeats(docs: DataFrame) -> DataFrame:
    """(d, t, spans): the matches of each document that has any, word ranges [lo, hi) and where their first occurrence
    stands (d, t, at).

    Every join on hashes is a `lookup`, so an owner, factor or window that very many texts share is dealt over many tasks.
    """
    texts = _once(_key(docs, "text"))
    rows = materialise(texts.mapInArrow(_factors, "d long, t long, owner long, whole long, place long"))
    owners = materialise(rows.groupBy("owner").agg(F.count("*").alias("k")).filter("k > 1"))
    shared = materialise(lookup(rows, owners, ["owner"], "k", rows.count()).drop("k"))
    discard(rows, owners)
    n_shared = shared.count()

    here = F.struct("d", "t", "place")
    references = shared.groupBy("owner", "whole").agg(F.min(here).alias("ref"), F.count("*").alias("k"))
    references = materialise(references)
    whole = lookup(shared, references.filter("k > 1"), ["owner", "whole"], "k", n_shared).filter(here != F.col("ref"))
    at, n = F.floor(F.col("place") / _SPAN), F.col("place") % _SPAN
    there = F.floor(F.col("ref.place") / _SPAN).alias("at")
    span = F.struct(at.alias("lo"), (at + n + (WINDOW - 1)).alias("hi"), F.col("ref.d").alias("d"), F.col("ref.t").alias("t"), there)
    factors = whole.select("d", "t", span.alias("span"))

    several = references.groupBy("owner").agg(F.count("*").alias("k")).filter("k > 1")
    asked = lookup(references.drop("k"), several, ["owner"], "k", n_shared).groupBy("ref.d", "ref.t")
    asked = asked.agg(F.collect_list("ref.place").alias("asked"))
    windows = texts.join(asked, ["d", "t"]).select("d", "t", "text", "asked").mapInArrow(_windows, "d long, t long, window long, at long")
    windows = materialise(windows)
    here = F.struct("d", "t", "at")
    firsts = windows.groupBy("window").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count("*").alias("k"))
    firsts = firsts.filter(F.col("first") != F.col("last")).select("window", "first", "k")
    late = lookup(windows, firsts, ["window"], "k", windows.count()).filter(here != F.col("first"))
    span = F.struct(F.col("at").alias("lo"), (F.col("at") + WINDOW).alias("hi"), "first.d", "first.t", "first.at")
    edges = late.select("d", "t", span.alias("span"))
    spans = materialise(factors.union(edges).groupBy("d", "t").agg(F.collect_list("span").alias("spans")))
    discard(shared, references, windows)
    return spans


def _with_spans(docs: DataFrame, *keep: str | Column) -> DataFrame:
    return _key(docs, *keep).join(repeats(docs), ["d", "t"], "left")


def parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, ref_doc_id, ref_lo): the phrases of each row of `docs` in words, in order: words [lo, hi) are those
    of the reference from ref_lo on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [phrases(spans.values) for spans in b.column("spans")]
            row = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 4)
            cols = [pa.array(c) for c in np.ascontiguousarray(flat.T)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), cols[0], cols[1], cols[2], cols[3]], ["doc_id", "lo", "hi", "ref_doc_id", "ref_lo"])

    rows = _with_spans(docs, F.col("doc_id").cast("long").alias("doc_id")).filter("spans IS NOT NULL").select("doc_id", "spans")
    out = rows.mapInArrow(cut, "doc_id long, lo long, hi long, ref_doc_id long, ref_lo long")
    return out.withColumn("ref_doc_id", F.nullif("ref_doc_id", F.lit(-(1 << 63))))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of `docs`."""
    rows = _with_spans(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", "spans")
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages taken out of `text` (and n_chars counted anew where it exists)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for x, spans in zip(b.column("_text"), b.column("_spans")):
                parse = phrases(spans.values)
                out.append(b" ".join(strip(_bytes(x).split(), parse)).decode("utf-8", "surrogatepass") if parse else x.as_py())
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(out, pa.string())], ["_row", "_text"])

    rest = [c for c in docs.columns if c != "text"]
    whole = F.struct(*named(rest)).alias("_row")
    rows = _with_spans(docs, whole, "text").select("_row", F.col("text").alias("_text"), F.col("spans").alias("_spans"))
    schema = rows.select("_row", "_text").schema
    done = rows.mapInArrow(cut, schema)
    out = {c: F.col("_row")[c] for c in rest} | {"text": F.col("_text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[out[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL of the definition, window by window."""
    last = WINDOW - 1
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {last}), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {last - 1})) AS i FROM w WHERE len(w) > {last})
), later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM later
), left_over AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w) ANTI JOIN gone USING (doc_id, j)
  GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)"""
