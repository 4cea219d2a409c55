import numpy as np
import pytest

from siftline.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, top=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = {}
    for q, x in ok:
        if q % every == 0:
            scored = sorted((-float(ann.exact(x, v[None])[0]), i) for i, v in ok if i != q)
            out[q] = [(i, -s) for s, i in scored[:top]]
    return out


def found(rows, spark, **options):
    out = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(1, 90)]
    rows += [(k, rows[0][1], 0) for k in range(100, 161)]  # copies: ties go to the smaller id
    rows += [(180, None, 0), (200, [], 0), (220, [0.0] * 8, 0), (240, [1.0, None] * 4, 0), (260, [float("nan")] * 8, 0), (280, [float("inf")] * 8, 0), (300, [1.0] * 3, 0), (None, [1.0] * 8, 0)]
    assert found(rows, spark) == brute(rows)
    assert found([], spark) == {} and found([(0, [1.0] * 8, 1)], spark) == {}
    assert found(rows[:5] + [(20, rows[7][1], 0)], spark) == brute(rows[:5] + [(20, rows[7][1], 0)])


def test_other_columns_are_not_read(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["v", "d", "part", "salt", "asks", "ask", "to", "query_id", "rank", "score", "text"]
    got, want = (sorted(map(tuple, ann.nearest(x).collect())) for x in (df.withColumns({n: F.lit("x" * 9999) for n in names}), df))
    assert got == want and len(want) == 15 * 20


def test_repeated_queries_keep_their_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(1, 60)]
    once = rows + [(60, [1.0] * 8, 0), (80, [1.0, -1.0] * 4, 0)]
    many = once + [(60, [1.0] * 8, 0)] * 2
    near = [x for x in brute(once)[60] if x[0] != 60]
    assert found(many, spark)[60] == near and len(near) == 20
    other = [-1.0] * 7 + [2.0]
    got = ann.nearest(spark.createDataFrame(many + [(60, other, 0)], SCHEMA)).filter("query_id = 60").collect()
    want = [(k + 1, i, s) for x in ([1.0] * 8, other) for k, (i, s) in enumerate(brute(once[:-2] + [once[-1], (60, x, 0)])[60])]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_recall_and_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    rows = [(k, (centres[k % 20] + 0.6 * rng.normal(size=8)).astype(np.float32).tolist(), 0) for k in range(3000)]
    want = brute(rows)
    for options in ({}, {"block": 50}):
        got = found(rows, spark, **options)
        hit = [len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) / 20 for q in want]
        assert np.mean(hit) >= 0.9
        assert all(s == dict(want[q]).get(i, s) for q in got for i, s in got[q])


def test_blocks_of_rows_and_queries_change_nothing(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(1200)]
    whole, cut = found(rows, spark, every=2), found(rows, spark, every=2, block=40)
    assert whole == cut and len(whole) == 600


def test_recall_on_the_test_table(spark):
    import pyarrow.parquet as pq

    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    ids = np.array([r[0] for r in rows])
    got = {}
    for r in queries.op9_learned_partitions(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -(x @ x[k]))) if j != k][:20]
        hits.append(len(set(ids[order]) & got[ids[k]]) / 20)
    assert np.mean(hits) >= 0.9


def test_stages_keep_columns_and_take_effect(spark, clashing, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        else:
            assert out.columns[:3] == ["doc_id", "piece", "start"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_pipeline_on_an_empty_table(spark, no_docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_writes_each_stage_and_equals_brute_force(spark, no_labels, tmp_path, monkeypatch):
    import corpus_pipeline
    from tests.llm.conftest import prose
    from tests.llm.test_dedup import brute_components, brute_removed, passages
    from tests.llm.test_rules_and_quality import brute_counts

    rows = passages(7) + [(100 + k, prose(400 + k, 80)) for k in range(8)] + [(200 + k, prose(400 + k, 80) + " end") for k in range(8)] + [(300, "a " * 90), (100, prose(408, 70))]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    good = [(d, t) for d, t in rows for n, _, _, _, repeats in [brute_counts(t)] if n >= 50 and 2 * repeats <= n]
    one = [(d, t) for d, t in good if brute_components([x for x in good if x[0] != d] + [(d, t)])[(d, len(set(zip(*[t.split()[k:] for k in range(5)]))), d, True)]]
    want = sorted((d, t if cut is None else cut) for (d, t), (*_, cut) in zip(one, brute_removed(one)))
    seen, stages = [], corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages[:3] + [("look", lambda spark, df, sf_dir: seen.append(df) or df)])
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    assert len(want) < len(good) < len(rows)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, f) for n, f in stages[:4]])
    mixed = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert mixed and set(mixed) <= {d for d, _ in want}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    from tests.test_queries import rows_of

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
