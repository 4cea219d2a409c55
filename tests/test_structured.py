"""Metadata, tables, policies and sinks on small pages worked out by hand."""

from pyspark.sql import functions as F

from siftline.operators import policies, sinks, structured

PAGE = """<html><head><meta property="og:title" content="A"><meta content='B' property='og:title'><meta name="twitter:card" content="c">
<script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">{broken</script></head><body>
<table class=x><tr><th>Name</th><th>Name</th><th></th></tr><tr><td>p <b>q</b></td><td>2</td><td>3</td><td>4</td></tr><tr><td>r</td></tr></table>
<table><tr><td><a href="/x">all of it linked</a></td></tr><tr><td>-</td></tr></table>
<table>%s</table><table><tr><td>only a header</td></tr></table></body></html>""" % ("<tr><td>one</td></tr>" * 12)


def test_metadata(spark):
    got = structured.metadata(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], ["page_id", "html"])).orderBy("page_id").collect()
    assert (got[0]["json_ld"], got[0]["open_graph"], got[0]["twitter"], got[0]["confidence"]) == (['{"@type": "Thing"}'], {"og:title": "B"}, {"twitter:card": "c"}, 0.7)
    assert (got[2]["json_ld"], got[2]["open_graph"], got[2]["confidence"]) == ([], {}, 0.0)


def test_tables(spark):
    got = structured.tables(spark.createDataFrame([(1, PAGE)], ["page_id", "html"])).orderBy("row_no").collect()
    assert [(r["table_no"], r["values"]) for r in got] == [(0, {"Name": "p q", "Name_2": "2", "column_3": "3", "column_4": "4"}), (0, {"Name": "r"})]


def test_table_heads_bodies_and_nesting(spark):
    page = """<table><caption> Prices </caption><thead><tr><th>Item<th>Cost <i>net</i></thead><tbody><tr><td><p>a <b>b</b></p><td>1</tr>
<tr><td>  <td> </tr><tr><td>c<table><tr><td>in</td></tr><tr><td>ner</td></tr></table></td><td>2</td></tr></tbody><tfoot><tr><td>all<td>3</tfoot></table>
<table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td>lone</td><td>row</td></tr></table>"""
    got = structured.tables(spark.createDataFrame([(1, page)], ["page_id", "html"])).orderBy("table_no", "row_no").collect()
    first = [r["values"] for r in got if r["table_no"] == 0]
    assert first[0] == {"Item": "a b", "Cost net": "1"} and first[1]["Item"].startswith("cin") and {r["caption"] for r in got if r["table_no"] == 0} == {"Prices"}
    assert [(r["table_no"], r["values"]) for r in got if r["table_no"] > 0] == [(2, {"x": "1", "y": "2"})]


def test_containers_nest(spark):
    page = '<div class="wrap"><div id="content"><p>one <a href="/">two</a></p><div><p>three</p></div></div><div class="share"><a href="/">x</a></div></div>'
    rows = structured.containers(spark.createDataFrame([(1, page)], ["page_id", "html"])).orderBy("element").collect()
    assert [(r["no"], r["names"], r["candidate"], r["length"], r["paragraphs"], r["linked"]) for r in rows] == [
        (0, "wrap", False, 13, 2, 4), (1, "content", True, 12, 2, 3), (2, "", False, 5, 1, 0), (3, "share", False, 1, 0, 1)
    ]
    plain = structured.containers(spark.createDataFrame([(1, "<div><p>a</p></div>")], ["page_id", "html"]))
    assert [r["candidate"] for r in plain.collect()] == [True]


def test_containers_prefer_articles(spark):
    page = '<nav class="menu"><a href="/">home</a></nav><article class="post content"><p>%s</p><p>y</p></article><div id="ad">buy</div>' % ("word " * 100)
    rows = structured.score_containers(structured.containers(spark.createDataFrame([(1, page)], ["page_id", "html"])))
    assert [r["tag"] for r in structured.chosen_containers(rows).collect()] == ["article"]
    assert {r["tag"]: r["score"] < 0 for r in rows.collect()} == {"nav": True, "article": False, "div": True}


def test_policy_patterns_anchor_first_and_last_only(spark):
    rows = spark.createDataFrame([("http://a.org.evil.com/",), ("http://xb.org/",), ("http://c.net/",), (None,)], ["u"])
    got = rows.select(structured.policy(F.col("u"), [("p", "a.org|b.org")], "none")).collect()
    assert [r[0] for r in got] == ["p", "p", "none", "none"]


def test_ten_thousand_patterns_in_a_table(spark):
    """First by place; as the patterns unrolled into one expression would have it."""
    import random

    r = random.Random(4)
    label = lambda: r.choice(["a", "b", "cc", "www", "m", "news", "x1"])

    def glob():
        parts = [r.choice(["*", label(), label(), label() + "*"]) for _ in range(r.randrange(1, 4))] + [label()]
        one = ".".join(parts)
        return one + "|" + ".".join(["*", label()]) if r.random() < 0.2 else one

    some = [(f"p{k:03}", k, glob()) for k in range(150)]
    hosts = sorted({".".join(label() for _ in range(r.randrange(1, 5))) for _ in range(150)})
    urls = spark.createDataFrame([(f"http://{h}/p", k) for k, h in enumerate(hosts)] + [(None, -1), ("no url", -2)], "u string, k long")
    schema = "name string, place long, pattern string"
    got = {x["k"]: x["policy"] for x in policies.match(urls, "u", spark.createDataFrame(some, schema), "none").collect()}
    want = {x["k"]: x["p"] for x in urls.select("k", structured.policy(F.col("u"), [(n, g) for n, _, g in some], "none").alias("p")).collect()}
    assert got == want and len(set(want.values())) > 10
    many = spark.range(10_000).selectExpr("concat('s', id) AS name", "id AS place", "concat('*.h', id, '.example') AS pattern")
    asked = spark.range(500).selectExpr("id * 20 AS k", "concat('https://www.h', id * 20, '.example/') AS u")
    assert {(x["k"], x["policy"]) for x in policies.match(asked, "u", many, "none").collect()} == {(k * 20, f"s{k * 20}") for k in range(500)}


def test_field_checks(spark):
    rows = spark.createDataFrame([("ab", ""), (None, "X1"), ("abcdef", "x")], ["t", "h"])
    out = structured.check_fields(rows, {"t": {"required": True, "min": 3, "max": 5}, "h": {"pattern": "^X"}}).collect()
    assert [r["violations"] for r in out] == [["t is too short"], ["t is required"], ["t is too long", "h has another form"]]


def test_csv_quoting_and_events(spark):
    rows = spark.createDataFrame([("a,b", 'say "x"', None, ["p", "q"])], "a string, b string, c string, d array<string>")
    assert sinks.csv_lines(rows, "a", "b", "c", "d").first()[0] == '"a,b","say ""x""",,p|q'
    assert sinks.event_lines(rows.select("a", "c"), "node").first()[0] == '{"type":"node","payload":{"a":"a,b"}}'


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, x string, y int")
    new = spark.createDataFrame([(2, "B", None), (3, "C", 33)], "id int, x string, y int")
    got = sinks.upsert(old, new, ["id"], ["y"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 10), (2, "b", None), (3, "C", 33)]
