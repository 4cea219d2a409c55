"""Search with bounds against search by all blocks."""

import numpy as np
import pytest

from siftline.operators import pruning, retrieval

ROWS = "id long, vector array<double>"


def clustered(seed, n, spread, groups=25, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(k, (centres[k % groups] + spread * rng.normal(size=dim)).tolist()) for k in range(n)]


def both(spark, rows, asked, k, least=None, **blocks):
    rows = spark.createDataFrame(rows, ROWS).repartition(4)
    asked = spark.createDataFrame(asked, "query_id long, vector array<double>")
    search = pruning.Search(rows, asked, k, least, **blocks)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    want = key(retrieval.block_search(rows, asked, k, least))
    assert key(search.hits) == want
    return search, want


@pytest.mark.parametrize("spread, least", [(0.1, None), (0.1, 0.9), (1.5, None)])
def test_hits_are_those_of_all_blocks(spark, spread, least):
    rows = clustered(1, 1500, spread)
    search, want = both(spark, rows, rows[::20], 5, least, row_block=50, query_block=20)
    assert len(want) == 5 * 75
    if spread < 1:
        assert search.skipped > 0.8


def test_odd_vectors_and_few_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [-1.0, 0.5, 2.0]), (6, [1.0]), (7, [0.0]), (8, [1.0, 0.0]), (9, [float("inf")])]
    asked = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (5, [-1.0, 0.5, 2.0]), (3, None)]
    _, want = both(spark, rows, asked, 3)
    assert [x[:3] for x in want if x[0] == 1] == [(1, 1, 1), (1, 2, 6), (1, 3, 8)]
    both(spark, [(2, [0.0]), (3, [0.0])], asked, 3)
    assert both(spark, [], asked, 3)[1] == [] and both(spark, rows, [], 3)[1] == []
