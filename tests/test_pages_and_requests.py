"""Hand-made cases for policies, selectors, listings, events, requests and limits."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.functions import requests, selectors
from siftline.operators import admission, assembly, marketplace, policies
from siftline.sources import config, exports


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "ip, private",
    [
        ("10.1.2.3", True), ("11.1.2.3", False), ("172.15.0.1", False), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.9.9", True), ("169.254.1.1", True),
        ("0.0.0.1", True), ("::1", True), ("fd00::1", True), ("fe80::1", True), ("2001:db8::1", False), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False),
        ("1:2:3:4:5:6:7:8", False), ("1:2:3", True), ("8.8.8.999", True), ("host", True), ("1::2::3", True),
    ],
)
def test_private_addresses(spark, ip, private):
    assert one(spark, requests.private_ip(F.col("ip")), ip=ip) is private


@pytest.mark.parametrize(
    "url, why",
    [
        ("https://a.example/x", "resolve"), ("ftp://a.example", "scheme"), ("javascript:x", "scheme"), ("nothing", "invalid"), ("http://", "invalid"), ("http://[1:2]/", "invalid"),
        ("http://bad.example:80/", "host"), ("http://10.0.0.7/", None), ("http://u@127.0.0.1", "private"), ("http://8.8.8.8/", None), ("HTTP://LocalHost/", "localhost"),
    ],
)
def test_blocked_urls(spark, url, why):
    assert one(spark, requests.blocked(F.col("u"), ["bad.example"], ["10.0.0.7"]), u=url) == why


def test_selectors(spark):
    html = '<div id="a" class="x y"><b class="xy">no</b> <i class="z y w"> one\n two </i></div><p data-k="v" title="t">p</p><div class="ad">q</div>'

    def get(c):
        return one(spark, c, h=html)

    assert get(selectors.text_of(F.col("h"), ".y")) is None  # the first such element begins with another tag
    assert get(selectors.text_of(F.col("h"), "i.y")) == "one two"
    assert get(selectors.text_of(F.col("h"), "#a i")) == "one two"
    assert get(selectors.attribute_of(F.col("h"), '[data-k="v"]', "title")) == "t"
    assert get(selectors.first_of(F.col("h"), [".none", '[data-k="v"]@title', "p"])) == "t"
    assert get(selectors.without(F.col("h"), ".ad")).endswith("p</p>")
    with pytest.raises(ValueError):
        selectors.pattern("a > b")


def test_policies(spark, tmp_path):
    rules = [{"name": "a", "domain": "a.*", "drop": [{"selector": "aside"}, {"regex": "Sponsor"}], "keep": [{"selector": "main"}]}, {"name": "rest", "domain": "*"}]
    html = "<body><aside>x</aside><main>kept <b>Sponsored</b></main><p>other</p></body>"
    rows = spark.createDataFrame([(1, "http://a.example/", html), (2, "http://b.example/", html), (3, "http://a.example/", "<p>no main</p>"), (4, None, None)], "k int, url string, html string")
    got = {r["k"]: r for r in policies.apply(rows, rules, "k").collect()}
    assert got[1]["html"] == "<body><main>kept <b></b></main></body>" and got[1]["rules_matched"] == 3
    assert got[2]["html"] == html and got[2]["rules_matched"] == 0 and got[2]["policy"] == "rest"
    assert got[3]["html"] == "<p>no main</p>" and got[4]["html"] is None
    assert policies.errors({"keep": [{}]}) == ["no name", "rule 0 has neither selector nor regex"]
    assert policies.fingerprint(rules) != policies.fingerprint(rules[:1]) and len(policies.fingerprint(rules)) == 8
    assert policies.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    (tmp_path / "n.yaml").write_text("name: n\ndrop:\n  - selector: aside\n")
    assert config.policies(str(tmp_path)) == [{"name": "n", "drop": [{"selector": "aside"}]}]
    (tmp_path / "o.yaml").write_text("drop: [{}]\n")
    with pytest.raises(ValueError):
        config.policies(str(tmp_path))


def calls(spark, seconds):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(1, k, at + timedelta(seconds=s)) for k, s in enumerate(seconds)], "user long, id long, ts timestamp")


def test_sliding_window_counts_only_admitted_calls(spark):
    got = admission.sliding_window(calls(spark, [0, 10, 20, 59, 60, 61, 71]), "user", "ts", "id", 2, 60).orderBy("id").collect()
    assert [(r["allowed"], r["retry_after"]) for r in got] == [(True, 0), (True, 0), (False, 40), (False, 1), (True, 0), (False, 9), (True, 0)]


def test_several_buckets_take_all_or_nothing(spark):
    got = admission.several_buckets(calls(spark, [0, 0, 1, 2, 3, 61]), "user", "ts", "id", [(1, 1), (3, 60)]).orderBy("id").collect()
    assert [(r["allowed"], r["denied_by"]) for r in got] == [(True, -1), (False, 0), (True, -1), (True, -1), (False, 1), (True, -1)]


def test_folds_keep_state_over_batches_and_keys(spark):
    rows = spark.range(2_000).select((F.col("id") % 2).alias("user"), "id", F.timestamp_seconds(F.col("id")).alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = admission.token_bucket(rows, "user", "ts", "id", 5.0, 0.0)
        assert {r["user"]: r["n"] for r in got.filter("allowed").groupBy("user").agg(F.count("*").alias("n")).collect()} == {0: 5, 1: 5}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_completeness_guard(spark):
    rows = [
        (1, "a", 0, "short", 1, 0.9), (1, "b", 1, "x" * 400, 1, 0.5), (1, "c", 2, "y " * 10, 4, 0.4),
        (2, "a", 0, "short", 1, 0.9), (2, "b", 1, "tiny", 0, 0.5), (3, "a", 0, "alone", 1, 0.9), (4, "a", 0, "word " * 90, 3, 0.9), (4, "b", 1, "z", 9, 0.1),
    ]
    scored = spark.createDataFrame(rows, "page_id long, method string, method_no int, content string, paragraph_count int, composite_score double")
    texts = spark.createDataFrame([(2, ["p1", "p2", "p3", "p4", "p5"])], "page_id long, texts array<string>")
    got = {r["page_id"]: r for r in assembly.complete(scored, texts).collect()}
    assert (got[1]["method"], got[1]["action"]) == ("c", "other")
    assert (got[2]["content"], got[2]["paragraph_count"], got[2]["action"]) == ("short\n\np1\n\np2\n\np3\n\np4", 5, "filled")
    assert got[3]["action"] == "kept" and got[4]["action"] == "kept"
    sure = assembly.heuristic_confidence
    assert one(spark, F.round(sure(F.lit(1), F.lit(500), F.lit(5)), 6), a="") == pytest.approx(0.133333 + 0.15 + 0.15, abs=1e-5)
    assert one(spark, F.round(sure(F.lit(9), F.lit(5000), F.lit(0)), 6), a="") == 1.0


def test_listings_mails_and_items(spark):
    assert one(spark, marketplace.sold_date(F.col("t")).cast("string"), t="x SOLD  jan 5, 2024 y") in ("2024-01-05", None)
    assert one(spark, marketplace.sold_date(F.col("t")).cast("string"), t="Sold Jan 5 2024") == "2024-01-05"
    assert one(spark, marketplace.sold_date(F.col("t")).cast("string"), t="Sold out") is None
    assert one(spark, marketplace.shop(F.col("u")), u="https://www.amazon.de/dp/1") == "amazon"
    assert one(spark, marketplace.shop(F.col("u")), u="https://notashop.example/ebay.") is None
    lines = ["$5 before any item", "A title that is long enough", "$1,234.50", "$2.00", "Used", "new", "A second title, long as well", "nothing priced"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "t long, line_no long, line string")
    got = marketplace.items_from_lines(rows, "t").collect()
    assert [(r["title"], r["amount"], r["condition"]) for r in got] == [("A title that is long enough", 1234.5, "new")]


def test_crawl_delays_and_sitemap_index(spark):
    robots = spark.createDataFrame([("a", "User-agent: x\nCrawl-delay: 3 # s\nUser-agent: *\ncrawl-delay: 1.5"), ("b", "Disallow: /")], "o string, t string")
    assert dict(exports.crawl_delays(robots, "o", "t", "X").collect()) == {"a": 3.0, "b": None}
    assert dict(exports.crawl_delays(robots, "o", "t", "y").collect()) == {"a": 1.5, "b": None}
    files = spark.createDataFrame(
        [("h/sitemap.xml", "<sitemapindex><sitemap><loc>h/1.xml</loc></sitemap></sitemapindex>"), ("h/1.xml", "<urlset><url><loc> h/p </loc></url></urlset>"), ("h/2.xml", "<url><loc>h/q</loc></url>")],
        "at string, xml string",
    )
    assert [r["url"] for r in exports.sitemap(files, "at", "xml", "/sitemap.xml").collect()] == ["h/p"]
