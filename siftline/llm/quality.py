"""A quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a good and a bad labelled document) say which text should score higher; the score is linear in the
features, and its weights minimise the logistic loss on feature differences of the pairs. The score quantile at the
share of bad labels then becomes the threshold: it is mapped to 0.3, the spread of scores to the steepness, so a
document is predicted good where its mapped score is 0.3 at least.

Features come from the text alone: frequencies of its bytes, and rates of words and lines. Fitted on a bounded sample
of labelled rows (`PER_LABEL` of each label, the first by a hash of doc_id); scores cover all rows, the threshold and
the spread all labelled rows that aren't held out, by exact places in the order of their scores.

Defined results: null and empty texts score like a text without words; rows with null ids are scored and never learnt
from; labels that disagree count by the smallest, null labels for nothing; repeated rows are scored each; with no pair
of labels every text scores 0.5; of texts under one id the first by hash is learnt from; texts that tie have one score;
very long texts are measured whole, one at a time; other columns are not looked at; an empty table gives no rows.
"""

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import materialise

#: Labelled rows of either label that the model is fitted on, at most, and pairs drawn from them.
PER_LABEL = 4_000
PAIRS = 40_000
THRESHOLD = 0.3
FOLDS = 5
#: Ranges that one pass over the scores counts, and scores that the driver sorts at most.
BINS, FEW = 1_024, 20_000
SEED = 3
_RATES = 9


def features(text: str | None) -> np.ndarray:
    """256 square roots of byte frequencies, then rates of words and lines, all within about 0 to 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, upper = max(1, len(words)), int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[128:].sum())
    rates = [
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        min(1.0, (len(raw) - len(words)) / n / 20),
        upper / max(1, letters),
        letters / max(1, len(raw)),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(len(words)) / 12),
        min(1.0, sum(counts[ord(c)] for c in "#*$%&|<>") / n),
        min(1.0, counts[33] / n),
    ]
    return np.concatenate([np.sqrt(counts / max(1, len(raw))), rates])


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w (good - bad))) over drawn pairs, by full-batch Adam."""
    rng = np.random.default_rng(SEED)
    i, j = rng.integers(len(good), size=pairs), rng.integers(len(bad), size=pairs)
    w = np.zeros(good.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = (good @ w)[i] - (bad @ w)[j]
        pull = 1 / (1 + np.exp(margin)) / pairs
        g = ridge * w - np.bincount(i, pull, len(good)) @ good + np.bincount(j, pull, len(bad)) @ bad
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def at_place(scores: DataFrame, k: int) -> float:
    """The value at place `k` (from 0) of the ascending column `s`, exactly: each pass keeps the range that holds it."""
    while True:
        n, lo, hi = scores.agg(F.count("s"), F.min("s"), F.max("s")).first()
        if lo == hi:
            return lo
        if n <= FEW:
            return sorted(r["s"] for r in scores.collect())[k]
        at = F.least(F.floor((F.col("s") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        for r in scores.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("at").collect():
            if k < r["n"]:
                scores = scores.filter(F.col("s").between(r["lo"], r["hi"]))
                break
            k -= r["n"]


def threshold(scores: DataFrame) -> tuple[float, float]:
    """From (q, s) of all labelled rows: the quantile of their scores at the share of bad labels, and half the spread
    between the labels' medians."""
    n = {r["q"]: r["n"] for r in scores.groupBy("q").agg(F.count("*").alias("n")).collect()}
    at = min(max(n[0] - 1, 0), n[0] + n[1] - 2)
    cut = (at_place(scores, at) + at_place(scores, at + 1)) / 2
    bad, good = (
        sum(at_place(scores.filter(F.col("q") == q), k) for k in ((n[q] - 1) // 2, n[q] // 2)) / 2 for q in (0, 1)
    )
    return cut, max(1e-6, (good - bad) / 2)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`; learns from rows that aren't held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    label = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"))
    label = label.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % FOLDS != 0)
    first = [label.filter(F.col("_q") == q).orderBy(F.xxhash64("_id"), "_id").limit(PER_LABEL) for q in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # 2 * PER_LABEL rows at most

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).astype(np.float32).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("_q"), pa.array(x, pa.binary())], ["q", "x"])

    # One text for each id, so what comes to the driver is bounded whatever ids repeat.
    learnt = rows.join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id", "_q")
    learnt = learnt.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("_q", "text")
    learnt = learnt.mapInArrow(featured, "q int, x binary").toArrow()
    x = np.array([np.frombuffer(v, np.float32) for v in learnt.column("x").to_pylist()], np.float64)
    q = np.array(learnt.column("q").to_pylist())
    if not ((q == 0).any() and (q == 1).any()):
        done = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
        return done.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    w = fit(x[q == 1], x[q == 0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.array([features(t.as_py()) @ w for t in b.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(raw)], ["doc_id", "held_out", "raw"])

    done = materialise(rows.mapInArrow(scored, "doc_id long, held_out boolean, raw double"))
    labelled = done.join(label.filter("_q IN (0, 1)"), F.col("doc_id") == F.col("_id"))
    cut, spread = threshold(materialise(labelled.select(F.col("_q").alias("q"), F.col("raw").alias("s"))))
    z = 4 * (F.col("raw") - cut) / spread + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    squashed = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    done = done.select("doc_id", "held_out", squashed.alias("score"))
    return done.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
