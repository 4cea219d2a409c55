"""Pages, texts and streams larger than the test tables': work that must not grow faster than its input."""

import re
import time

import pandas as pd

from siftline.operators import marketplace, structured
from siftline.streaming.ordered import InOrder


def test_entries_of_a_long_page_of_results(spark):
    card = '<li class="s-card"><div class="s-card__title"><span>Item {0} é</span></div><span class="s-card__price">$1{0}.50</span><a href="/itm/{0}?x=1">go</a></li>'
    page = "<ul>" + "\n".join(card.format(k) for k in range(3000)) + "</ul>"
    began = time.time()
    rows = marketplace.parse_search_results(spark.createDataFrame([(1, page)], "id int, html string"), "id").orderBy("place").collect()
    assert [(r.place, r.title, r.amount, r.item_id) for r in rows] == [(k, f"Item {k} é", float(f"1{k}.5"), str(k)) for k in range(3000)]
    assert time.time() - began < 60


def test_many_long_tables_on_a_page(spark):
    table = "<table><tr><th>Key</th><th>Name</th></tr>" + "".join(f"<tr><td>{k}</td><td> <b>n</b>{k}</td></tr>" for k in range(450)) + "</table>"
    began = time.time()
    rows = structured.tables(spark.createDataFrame([(1, table * 40)], "page_id int, html string")).orderBy("table_no", "row_no").collect()
    assert [(r.table_no, r.row_no, r["values"]) for r in rows] == [(t, k, {"Key": str(k), "Name": f"n{k}"}) for t in range(40) for k in range(450)]
    assert time.time() - began < 40


class Handle:
    """Counts what a processor asks of its state."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getValueState(self, name, *schema):
        return self

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def exists(self):
        self.calls += 1
        return False

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def update(self, value):
        self.calls += 1


def test_rows_of_a_key_wait_together(spark):
    """A key's rows over a month, minutes and hours apart, take a few calls to the state, not some for each."""
    handle, day = Handle(), 86_400_000_000
    processor = InOrder(lambda state, at, values: (state, []), None, ["v"], ["k", "v"], 60_000)
    processor.init(handle)
    list(processor.handleInputRows(("a",), iter([pd.DataFrame({"row_at": [k * day // 3 for k in range(90)], "v": ["x"] * 90})]), None))
    assert handle.calls <= 4 and len(handle.timers) == 1


def test_trimming_takes_spaces_alone(spark, tmp_path):
    """Texts of a page that begin or end with the digit of their own place."""
    from siftline.plans import records

    spark.createDataFrame([(6, "<p>first text of a page 0</p><p> 1 second text of it 1 </p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = records.span_offsets(spark, str(tmp_path)).orderBy("span_no").collect()
    assert [r.end - r.start for r in rows] == [22, 21]


def test_described_pages_are_not_broadcast(spark, capsys):
    from pyspark.sql import functions as F

    from siftline.operators import records

    pages = spark.range(10).select(F.col("id").alias("page_id"), F.lit('<script type="application/ld+json"> {"@type":"A"} </script><p itemprop="x">y').alias("html"))
    out = records.described(pages)
    out.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert [(r["items"], r.microdata) for r in out.collect()] == [(['{"@type":"A"}'], {"x": "y"})] * 10


def test_mails_are_written_by_many_tasks(spark, tmp_path):
    """A file for each mail, none of them by way of one task or with a checksum file beside it."""
    from pathlib import Path

    from siftline.plans import tables

    spark.range(40).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    held = set(shared.glob("stream-*"))
    rows = tables.mailed_suppliers(spark, str(tmp_path)).collect()
    (folder,) = set(shared.glob("stream-*")) - held
    files = [f.name for f in folder.iterdir() if "part-" in f.name]
    assert sorted(r.s_name for r in rows) == sorted(f"S{k}" for k in range(40))
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 1


def test_answers_are_searched_once(spark, tmp_path, capsys):
    """Neither the vectors nor the search are worked out again for each step that uses the hits."""
    from siftline.plans import retrieval

    rows = [(k, f"Word{k % 3} number {k}. More of it.") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = retrieval.screened_answers(spark, str(tmp_path))
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" not in plan
    assert {r.query_id: r.n_sources for r in out.collect()} == {0: 3, 20: 3}


def test_tokens_are_hashed_in_pieces(monkeypatch):
    import functools
    import random

    import numpy as np
    import pyarrow as pa

    from siftline.operators import retrieval

    pick = random.Random(3)
    texts = [None, "", "a", "b", "", "é a", "x" * 500, " ", "abc", "def"] + ["".join(pick.choice("ab9 é\n") for _ in range(pick.randrange(30))) for _ in range(200)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    for dims in (7, 64):
        want = np.zeros((len(texts), dims), int)
        for line, text in zip(want, texts):
            for token in re.findall("[a-z0-9]+", text or ""):
                line[functools.reduce(lambda h, c: (h * 31 + ord(c)) % dims, token, 0)] += 1
        for size in (1, 40, 1_000_000):
            monkeypatch.setattr(retrieval, "TEXT_BYTES", size)
            keys, counts = zip(*retrieval._token_counts(iter([batch.slice(0, 3), batch.slice(3), batch.slice(0, 0)]), dims))
            assert [k for part in keys for k in part.to_pylist()] == list(range(len(texts)))
            assert (np.concatenate(counts) == want).all()


def test_block_of_copies_and_zero_vectors():
    import numpy as np
    import pyarrow as pa

    from siftline.operators.retrieval import ranked_block

    pick = np.random.default_rng(5)
    v = pick.integers(0, 4, (1250, 16)).astype(float)
    v[:400], v[400:410], v[1200:1203] = v[0], 0, 0
    v[1204] = v[0]
    ids, asks = pick.permutation(1250), np.arange(1250) >= 1200
    block = pa.table({"id": pa.array(ids), "v": pa.array(list(v))})
    norm = np.sqrt((v * v).sum(axis=1))
    score = v @ v.T / np.where(norm == 0, 1, norm) / np.where(norm == 0, 1, norm)[:, None]
    for k, least in ((3, None), (20, 0.5), (3, 0.0)):
        want = []
        for n in np.flatnonzero(asks):
            rows = [(-round(score[n, m], 9), ids[m]) for m in np.flatnonzero(~asks) if least is None or score[n, m] >= least]
            want += [(ids[n], i) for _, i in sorted(rows)[:k]]
        got = ranked_block(block, asks, k, least)
        assert list(zip(got["query_id"].to_pylist(), got["id"].to_pylist())) == want


def test_a_page_travels_once(spark, capsys):
    """What a task holds is a batch of pages, not a second copy of their sources beside it."""
    from siftline.operators import elements

    pages = spark.createDataFrame([(k, f"<p>text {k}</p>" if k % 5 else None) for k in range(200)], "page_id int, html string")
    out = elements.with_elements(pages, ["p"], texts=["p"])
    capsys.readouterr()
    out.explain()
    (line,) = [x for x in capsys.readouterr().out.splitlines() if "MapInArrow" in x]
    assert re.search(r"read\((.*?)\)", line)[1].count("#") == 1
    got = {r.page_id: (r.html, r.flow, [e.text for e in r.elements]) for r in out.collect()}
    assert got == {k: (f"<p>text {k}</p>", f"text {k}", [f"text {k}"]) if k % 5 else (None, "", []) for k in range(200)}
