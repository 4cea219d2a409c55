import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import quality, rules
from tests.llm.conftest import DOC, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    w = WORD.findall(text or "")
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_of_odd_documents(clashing, labels, no_labels, no_docs):
    got = rules.verdicts(clashing, labels)
    want = Counter((r["doc_id"], *brute_counts(r["text"])) for r in clashing.collect())
    rows = got.collect()
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert all(r["kept"] != r["base_failed"] for r in rules.verdicts(clashing, no_labels).collect())
    assert rules.verdicts(no_docs, labels).collect() == []


def test_binomial_bound_is_exact(spark):
    rows = [(n, k) for n in (5, 80, 3000) for k in (0, 1, 3) if k <= n]
    df = spark.createDataFrame(rows, "n long, k long").select("n", "k", rules.binomial_cdf(F.col("n"), F.col("k"), 0.02).alias("p"))
    for n, k, p in df.collect():
        assert p == pytest.approx(sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)), rel=1e-9)


@pytest.fixture(scope="module")
def corpus(spark):
    """900 good documents and 150 with symbols after their words; every tenth has no label."""
    rows, labels = [], []
    for d in range(1050):
        text = prose(d, 90)
        if d % 7 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((d, text, "en" if d % 20 else None, f"s{d % 3}", len(text)))
        if d % 10:
            labels.append((d, int(d % 7 != 0), 0))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_catch_bad_documents_and_spare_good_ones(corpus):
    docs, labels = corpus
    rows = {r["doc_id"]: r["kept"] for r in rules.verdicts(docs, labels).collect()}
    assert all(rows[d] for d in rows if d % 7)
    # The stratum without a language has too few good documents to certify anything.
    assert not any(rows[d] for d in rows if d % 7 == 0 and d % 20)
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in rows.items() if k}


def test_no_python_in_the_rules_plan(corpus):
    docs, labels = corpus
    plan = rules.verdicts(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keep_good_leaves_other_columns(clashing, labels):
    out = rules.keep_good(clashing, labels)
    assert out.columns == clashing.columns


def test_classifier_on_held_out_rows(corpus):
    docs, labels = corpus
    rows = quality.score(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert sum(r["predicted"] == int(r["doc_id"] % 7 != 0) for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_not_learnt_from(corpus):
    docs, labels = corpus
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(docs, x).collect()} for x in (labels, other))
    assert a == pytest.approx(b)


def test_threshold_covers_all_labels(spark, corpus, monkeypatch):
    """Fitted on ten rows of each label, the cut still parts all labelled rows at the share of bad ones."""
    docs, labels = corpus
    monkeypatch.setattr(quality, "PER_LABEL", 10)
    noisy = labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    known = {r["doc_id"]: r["quality"] for r in noisy.collect()}
    rows = [r for r in quality.score(docs, noisy).collect() if r["doc_id"] in known and not r["held_out"]]
    n_bad = sum(known[r["doc_id"]] == 0 for r in rows)
    assert n_bad > 10 and sum(r["predicted"] == 0 for r in rows) == n_bad


def test_places_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 5)
    values = sorted([1.0] * 40 + [k / 7 for k in range(-50, 50)] + [1e9, 1.0 + 2**-52])
    scores = spark.createDataFrame([(v,) for v in values], "s double")
    assert [quality.at_place(scores, k) for k in (0, 70, 100, len(values) - 2, len(values) - 1)] == [values[k] for k in (0, 70, 100, len(values) - 2, len(values) - 1)]


def test_scores_of_odd_documents(clashing, labels, no_labels, no_docs):
    rows = quality.score(clashing, labels).collect()
    assert len(rows) == clashing.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score(clashing, no_labels).collect()} == {0.5}
    assert quality.score(no_docs, labels).collect() == []


def test_fit_minimises_the_pairs_logistic_loss():
    """Against plain gradient descent on every term of the loss, written out pair by pair."""
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.4, 1, (30, 5)), rng.normal(-0.4, 1, (25, 5))
    w = quality.fit(good, bad, pairs=400, steps=3000, ridge=1e-2)
    draw = np.random.default_rng(quality.SEED)
    i, j = draw.integers(30, size=400), draw.integers(25, size=400)
    x = good[i] - bad[j]

    def loss(v):
        return np.mean(np.log1p(np.exp(-x @ v))) + 0.5e-2 * v @ v

    v = np.zeros(5)
    for _ in range(20_000):
        v -= 0.3 * (1e-2 * v - x.T @ (1 / (1 + np.exp(x @ v))) / 400)
    assert loss(w) <= loss(v) + 1e-4 and np.allclose(w, v, atol=0.05)


def test_scores_by_brute_force(spark, corpus):
    """Scores, fold and verdict of every document from features, weights, cut and spread computed one by one."""
    docs, labels = corpus
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {}
    for r in labels.collect():
        if r["quality"] is not None and r["doc_id"] is not None:
            known[r["doc_id"]] = min(r["quality"], known.get(r["doc_id"], 1))
    learn = {d: q for d, q in known.items() if zlib.crc32(str(d).encode()) % 5 and d in texts}
    x = {d: quality.features(t).astype(np.float32).astype(float) for d, t in texts.items()}
    # The order of the rows a model is fitted on decides which pairs are drawn, so weights agree but not to the last digit.
    w = quality.fit(np.array([x[d] for d in learn if learn[d] == 1]), np.array([x[d] for d in learn if learn[d] == 0]))
    raw = {d: float(quality.features(t) @ w) for d, t in texts.items()}
    ranked = sorted(raw[d] for d in learn)
    bad, good = (sorted(raw[d] for d in learn if learn[d] == q) for q in (0, 1))
    cut = (ranked[len(bad) - 1] + ranked[len(bad)]) / 2
    spread = (np.median(good) - np.median(bad)) / 2
    want = {d: 1 / (1 + np.exp(-np.clip(4 * (r - cut) / spread + np.log(0.3 / 0.7), -40, 40))) for d, r in raw.items()}
    rows = quality.score(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    got = {r["doc_id"]: r["score"] for r in rows}
    assert np.corrcoef([got[d] for d in got], [want[d] for d in got])[0, 1] > 0.98
    assert sum((got[d] >= 0.3) == (want[d] >= 0.3) for d in got) >= 0.98 * len(got)


def test_one_id_with_many_texts_is_learnt_once(spark, corpus):
    docs, labels = corpus
    many = docs.union(docs.filter("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    assert len(quality.score(many, labels).collect()) == docs.count() + 500
