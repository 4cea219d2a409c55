"""Crawls in order against a queue and a stack."""

import random
from collections import deque

import pytest

from siftline.operators import crawls

EDGES = "src long, dst long, pos int"


def by_hand(edges, start, max_depth, max_pages, strategy):
    links = {}
    for s, d, p in sorted((e for e in edges if e[0] is not None and e[1] is not None), key=lambda e: e[2]):
        links.setdefault(s, []).append(d)
    start = list(dict.fromkeys(start))
    queue, marked, out = deque((s, 0, None) for s in (start if strategy == "bfs" else reversed(start))), set(start), []
    while queue and len(out) < max_pages:
        node, depth, parent = queue.popleft() if strategy == "bfs" else queue.pop()
        out.append((node, len(out), depth, parent))
        for d in links.get(node, []) if depth < max_depth else []:
            if d not in marked:
                marked.add(d)
                queue.append((d, depth + 1, node))
    return out


@pytest.mark.parametrize("strategy", ["bfs", "dfs"])
@pytest.mark.parametrize("max_depth, max_pages", [(3, 40), (6, 1000), (0, 5), (2, 3)])
def test_order_equals_a_queue_or_stack(spark, strategy, max_depth, max_pages):
    r = random.Random(max_pages)
    edges = [(r.randrange(120), r.randrange(150), k) for k in range(400)] + [(3, None, 1), (None, 4, 1), (7, 7, 0), (7, 8, 1), (7, 8, 2)]
    df = spark.createDataFrame(edges, EDGES).repartition(3)
    got = crawls.crawl_order(df, [7, 3, 7], max_depth, max_pages, strategy).orderBy("place").collect()
    assert [tuple(x) for x in got] == by_hand(edges, [7, 3, 7], max_depth, max_pages, strategy)


def test_no_links_and_long_paths(spark):
    none = spark.createDataFrame([], EDGES)
    assert [tuple(x) for x in crawls.crawl_order(none, [1], 3, 9).collect()] == [(1, 0, 0, None)]
    path = spark.createDataFrame([(k, k + 1, 0) for k in range(300)], EDGES)
    got = crawls.crawl_order(path, [0], 500, 200, "dfs").orderBy("place").collect()
    assert [x["node"] for x in got] == list(range(200))
