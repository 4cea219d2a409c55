"""Character references in pages, whole and cut short, as headings are that were cut to a length."""

import duckdb
import pytest

from siftline import catalog
from siftline.operators import elements
from tests.test_queries import rows_of

#: Queries that read references in the elements of pages.
QUERIES = ["page_nodes", "source_spans", "page_observations", "container_scores", "heuristic_extractions", "confidence_breakdown", "select_best_extraction", "stream_texts", "page_events", "event_lines"]
TAILS = ["token = &quot", "is &lt", "it&#39", "by &copy", "fish &amp", "fish &am", "so &quotx; said", "five&nbsp;", "&ampquot; &#39;x&#39;", "&quot;whole&quot;"]


@pytest.mark.parametrize(
    "source, want",
    [
        ("&quot;a&quot; &lt;b&gt; it&#39;s &copy; &middot; &eacute; &#x41;", "\"a\" <b> it's © · é A"),
        ("a&quot b&lt c&#39 d&copy e&middot f&#3 g&quo", "a&quot b&lt c&#39 d&copy e&middot f&#3 g&quo"),
        ("x&amp y&ampz &amp;lt; &ampquot; &", "x& y&z &lt; &quot; &"),
        ("&quotx; &ltamp; &nosuchname; &;", "&quotx; &ltamp; &nosuchname; &;"),
        ("a&nbsp;b", "a b"),
    ],
)
def test_whole_references_are_read(source, want):
    p = elements.Page(f"<p title='{source}'>{source}</p>", frozenset("p"))
    assert p.rows[0][8] == p.rows[0][5]["title"] == want


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages as in the tables, the headings of which end in the TAILS."""
    folder, p = tmp_path_factory.mktemp("cut"), "<p>A paragraph &amp; more that is long enough to be kept.</p>"
    page = '<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><article><h1>{0}</h1>{1}</article><footer>&copy; x</footer></body></html>'
    rows = [(k, f"https://www.x.example/{k}", page.format(f"A heading with words {t}", p * 4)) for k, t in enumerate(TAILS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_on_cut_references(spark, cut_pages, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{cut_pages}/pages.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, cut_pages).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)
