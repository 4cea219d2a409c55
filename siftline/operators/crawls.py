"""Crawls of a link graph in the order in which pages are visited, within a budget of pages.

Pages are marked when a link to them is first seen, and visited breadth first (first seen, first visited) or depth first
(last seen, first visited); links of a page are taken in their order in it. `edges` holds (src, dst, pos).
"""

from pyspark.sql import DataFrame, functions as F

from siftline.functions.running import checkpointing, totals

#: Pages whose links a crawl in depth asks for at a time.
AHEAD = 64


def crawl_order(edges: DataFrame, start: list, max_depth: int, max_pages: int, strategy: str = "bfs") -> DataFrame:
    """(node, place, depth, parent) of the first `max_pages` pages visited, starts first, in the order given.

    bfs: a level is one job. Pages new to it get the first link that leads to them, by (parent's place, place in the
    page), and their places by running numbers over ranges of that order, so no task holds a level.

    dfs: each visit depends on the one before, so the budget bounds the work: links are looked up for the next pages of
    the stack in batches, of which the driver holds no more than `max_pages` pages' links, and only as many entries of
    the stack as may still be visited.

    Links to pages that have none are visited as well; null ends are left out; links that repeat count once, at their
    first place; starts that repeat count once; an empty graph gives the starts.
    """
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    start = list(dict.fromkeys(s for s in start if s is not None))
    return (_in_depth if strategy == "dfs" else _in_breadth)(edges, start, max_depth, max_pages)


def _in_breadth(edges: DataFrame, start: list, max_depth: int, max_pages: int) -> DataFrame:
    spark = edges.sparkSession
    checkpointing(spark)
    kind = edges.schema["src"].dataType.simpleString()
    rows = [(s, k, 0, None) for k, s in enumerate(start[:max_pages])]
    level = seen = spark.createDataFrame(rows, f"node {kind}, place long, depth int, parent {kind}")
    n = len(rows)
    for depth in range(1, max_depth + 1):
        if n >= max_pages:
            break
        ends = edges.join(level.select(F.col("node").alias("src"), "place"), "src")
        first = ends.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("place", "pos", "src")).alias("by"))
        new = first.join(seen.select("node"), "node", "left_anti").select("node", "by.place", "by.pos", F.col("by.src").alias("parent"))
        numbered = totals(new, [], ["place", "pos"], _k=F.lit(1))
        level = numbered.select("node", (F.col("_k") + n).alias("place"), F.lit(depth).alias("depth"), "parent")
        level = level.filter(F.col("place") < max_pages).checkpoint()
        found = level.count()
        if not found:
            break
        seen, n = seen.union(level), n + found
    return seen


def _in_depth(edges: DataFrame, start: list, max_depth: int, max_pages: int) -> DataFrame:
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    edges = edges.repartition("src").persist()
    # The reversed starts, so the first one is on top.
    stack, marked, known, out = [(s, 0, None) for s in reversed(start)], set(start), {}, []
    while stack and len(out) < max_pages:
        node, depth, parent = stack.pop()
        out.append((node, len(out), depth, parent))
        if depth >= max_depth:
            continue
        if node not in known:
            ask = [node, *[s for s, d, _ in stack[: -AHEAD : -1] if d < max_depth and s not in known]]
            known |= {s: [] for s in ask}
            found = edges.filter(F.col("src").isin(ask)).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("to")).collect()
            known |= {r["src"]: [e["dst"] for e in r["to"]] for r in found}
        for dst in known.pop(node):
            if dst not in marked:
                marked.add(dst)
                stack.append((dst, depth + 1, node))
        stack = stack[-(max_pages - len(out)) :] if len(out) < max_pages else []
    edges.unpersist()
    return spark.createDataFrame(out, f"node {kind}, place long, depth int, parent {kind}")
