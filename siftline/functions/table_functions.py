"""Table functions for SQL text: the elements of a page beside its row (LATERAL), and folds over a partition's rows in order.

    SELECT p.page_id, n.* FROM pages p, LATERAL sift_nodes(p.html) n
    SELECT * FROM sift_history(TABLE(SELECT source, doc_id, text FROM documents) PARTITION BY source ORDER BY doc_id)

`sift_nodes` gives the nodes of `operators.extraction.nodes`. `sift_cells` gives the cells of all tables of a page with
their row and place. `sift_history` reads a key, a place and a text and says of each version whether it changed; it holds
one hash of a partition at a time, whatever its size. Null pages have no nodes and no cells; a null text is a version as
an empty one is.
"""

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from siftline.operators.elements import Page

_NODES = frozenset("p li h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset(["td", "th"])


def _collapse(text: str) -> str:
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")


class Nodes:
    def eval(self, html: str) -> Iterator[tuple]:
        found = [r for r in Page(html or "", _NODES).rows if r[4] in _NODES]
        for k, r in enumerate(found):
            text = _collapse(r[9])
            if text:
                yield k, r[4], text


class Cells:
    def eval(self, html: str) -> Iterator[tuple]:
        rows = Page(html or "", _CELLS).rows
        tables = [r for r in rows if r[4] == "table"]
        number = {r[0]: k for k, r in enumerate(tables)}
        seen: dict[int, list[int]] = {}
        for r in rows:
            if r[4] not in ("tr", "td", "th"):
                continue
            own = max((t[0] for t in tables if t[0] < r[0] <= t[1]), default=None)
            if own is None:
                continue
            at = seen.setdefault(own, [-1, 0])
            if r[4] == "tr":
                at[0], at[1] = at[0] + 1, 0
            else:
                yield number[own], max(at[0], 0), at[1], _collapse(r[8])
                at[1] += 1


class History:
    def __init__(self) -> None:
        self.last: str | None = None
        self.version = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        key, place, text = row
        digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
        self.version += 1
        yield str(key), int(place), self.version, "first" if self.last is None else "same" if digest == self.last else "changed"
        self.last = digest


FUNCTIONS = {
    "sift_nodes": (Nodes, "node_no int, tag string, text string"),
    "sift_cells": (Cells, "table_no int, row_no int, cell_no int, text string"),
    "sift_history": (History, "key string, place long, version int, kind string"),
}


def register(spark: SparkSession) -> list[str]:
    """Names of the functions, which live as long as the session."""
    for name, (handler, kind) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=kind))
    return list(FUNCTIONS)
