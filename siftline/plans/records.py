"""Queries on records of other programs, content addresses, spans, watches, source health, metadata and SQL functions."""

from pyspark.sql import functions as F

from siftline.functions import html, registry, urls
from siftline.functions.running import totals
from siftline.operators import assembly, elements, operations, provenance, records, structured
from siftline.plans.extraction import PIECES_SQL, _texts_sql, dealt, table
from siftline.plans.provenance import _CANON
from siftline.plans.structured import _SCORED

AS_OF = "2024-01-20 12:00:00"


def captured_orders(spark, sf_dir):
    """Orders as a browser captured them, one JSON for each: some without items, some items without a title."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    item = F.struct(
        F.when(n % 5 > 0, F.concat(F.lit("Part "), "l_partkey")).alias("title"), F.when(n % 2 == 0, F.concat(F.lit("B0"), "l_partkey")).alias("asin"),
        F.when(n % 3 > 0, F.col("l_extendedprice")).alias("price"), F.when(n % 4 > 0, F.col("l_quantity").cast("int")).alias("quantity"),
    )
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("e"), item.alias("i")))).alias("x"))
    fields = {
        "orderId": k.cast("string"), "status": F.when(k % 3 == 0, "Delivered today").otherwise("On its way"), "total": F.lit(9.5),
        "items": F.when(k % 7 > 0, F.transform("x", lambda x: x["i"])), "title": F.when(k % 7 == 0, F.lit("Whole order")),
    }
    rows = items.select("l_orderkey", F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])).alias("json"))
    return records.captured_orders(rows, "json", "l_orderkey").select("l_orderkey", "order_id", "item_no", "item_id", "title", "price", "quantity", "availability")


def answer_parts(spark, sf_dir):
    head = F.col("source")
    said = F.regexp_replace("text", r"\s+", " ")
    text = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("TITLE: "), head, F.lit("\nCONTENT: x"), said, F.lit("\nSUMMARY: short of "), head, F.lit("\n  "))).otherwise(F.concat(F.lit(" no parts "), F.col("doc_id"), F.lit(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in records.answer_parts(text).items()])


def answered_listings(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.to_json(
        F.struct(
            F.col("p_name").alias("title"), F.when(k % 3 > 0, F.col("p_retailprice")).alias("price"), F.lit("EUR").alias("currency"),
            F.when(k % 2 == 0, "used").otherwise("Brand new").alias("condition"), F.when(k % 4 > 0, k.cast("string")).alias("itemNumber"),
            F.when(k % 5 == 0, "eBay UK").when(k % 5 == 1, "a shop").alias("marketplace"), F.lit(0.7).alias("confidence"),
        )
    )
    answer = F.when(k % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 6 == 1, "I can't tell.").when(k % 6 == 2, F.lit('{"title": 7, "price": "12"}')).otherwise(body)
    rows = table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"), F.when(k % 9 == 0, "short").otherwise(F.repeat(F.lit("long "), 200)).alias("source"))
    out = records.answered_listings(rows, "answer", "source", "p_partkey")
    return out.withColumn("confidence", F.round("confidence", 6))


def content_addresses(spark, sf_dir):
    """Addresses of pages, kept beside bodies of which some were changed since."""
    k, kind = F.col("page_id"), F.lit("text/html")
    stored = provenance.address(F.col("html"), F.col("url"), kind)
    stored = F.when(k % 7 == 0, F.upper(stored)).otherwise(stored)
    now = F.when(k % 5 == 0, F.concat(F.col("html"), F.lit("<p>more</p>"))).when(k % 5 == 1, F.concat(F.col("html"), F.lit("  \n <!-- note -->"))).otherwise(F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", stored.alias("h"), now.alias("now"))
    return rows.select(
        "page_id", provenance.verified(F.col("h"), F.col("now"), F.col("url"), kind).alias("verified"), provenance.digest(F.col("h")).alias("digest"),
        provenance.same(F.col("h"), provenance.address(F.col("now"), F.col("url"), kind)).alias("same"), provenance.storage_key(F.col("h")).alias("storage_key"),
    )


def _spans(spark, sf_dir):
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("é日 "), "html").alias("html"))
    texts = F.filter(F.transform(html.blocks(F.col("html"), "p"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    rows = pages.select("page_id", "html", F.posexplode(texts).alias("span_no", "text"))
    rows = rows.withColumn("s", provenance.span(F.col("text"), F.col("html")))
    spans = rows.select(
        "page_id", "span_no", F.when(k % 6 == 1, -1).otherwise(F.col("s.start")).alias("start"), F.when(k % 6 == 2, 10_000_000).otherwise(F.col("s.end")).alias("end"),
        F.col("s.byte_start").alias("byte_start"), F.col("s.byte_end").alias("byte_end"), F.sha2("html", 256).alias("content_hash"),
    )
    return pages, spans


def span_offsets(spark, sf_dir):
    return _spans(spark, sf_dir)[1].drop("content_hash")


def verified_spans(spark, sf_dir):
    """Spans held against pages of which some have changed since."""
    pages, spans = _spans(spark, sf_dir)
    now = pages.withColumn("html", F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    return provenance.verify_spans(spans, now, "page_id")


def text_hashes(spark, sf_dir):
    """The 32-bit rolling hash of each document, with a character beyond the basic plane."""
    text = F.concat(F.lit("😀"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", urls.rolling_hash(text).alias("hash"))


def due_watches(spark, sf_dir):
    """Watches on users' pages, checked at their last event so far, every one to five hours; some paused."""
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").filter(F.col("ts").cast("timestamp") <= F.lit(AS_OF).cast("timestamp"))
    rows = rows.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_checked"))
    state = F.when(u % 4 == 0, "paused").when(u % 9 == 0, "error").otherwise("active")
    rows = rows.withColumns({"status": state, "interval": (u % 5 + 1) * 3_600})
    return records.due(rows, F.lit(AS_OF).cast("timestamp")).select("user_id", "overdue")


def source_health(spark, sf_dir):
    out = records.source_health(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", F.col("value") >= 10, F.lit(AS_OF).cast("timestamp"), 0.85)
    return out.withColumns({"failure_rate": F.round("failure_rate", 6), "reliability": F.round("reliability", 6)})


def bucket_percentiles(spark, sf_dir):
    """p95 as a bucket's upper bound: the first whose count reaches it, and as the service reads it, adding up counts that
    are cumulative already."""
    rows = operations.histogram(table(spark, sf_dir, "events"), "value", "event_type")
    bounds = [*map(str, operations.BUCKETS), "inf"]
    wide = rows.groupBy("event_type").agg(*[F.max(F.when(F.col("bound") == b, F.col("n"))).alias(f"b{k}") for k, b in enumerate(bounds)])
    total, run = F.col(f"b{len(bounds) - 1}"), F.lit(0)
    exact, served = F, F
    for k, b in enumerate(bounds):
        run = run + F.col(f"b{k}")
        exact, served = exact.when(F.col(f"b{k}") >= total * 0.95, b), served.when(run >= total * 0.95, b)
    return wide.select("event_type", exact.alias("bound"), served.alias("served_bound"))


def backfill_progress(spark, sf_dir):
    """Batches of 50 lines of each supplier's backlog: their size, and the mean value of all batches so far."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"))
    rows = totals(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "cents"], no=F.lit(1), sofar=F.col("cents"))
    out = rows.groupBy("l_suppkey", F.floor(F.col("no") / 50).cast("long").alias("batch")).agg(
        F.count("*").alias("n"), F.max("no").alias("_no"), F.max(F.col("sofar") + F.col("cents")).alias("_sum")
    )
    return out.select("l_suppkey", "batch", "n", (F.col("_sum") / (F.col("_no") + 1) / 100).alias("mean_so_far"))


def delivered_events(spark, sf_dir):
    """Events a subscriber gets who wants errors and views of at least 50: an event without a value passes too."""
    value = F.when(F.col("event_id") % 3 > 0, F.col("value"))
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view") & F.coalesce(value >= 50, F.lit(True)))
    return rows.groupBy("event_type", (F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.count(value).alias("n_valued"), F.round(F.avg(value), 4).alias("mean"))


def described_pages(spark, sf_dir):
    """Metadata of pages: JSON-LD as an object, an array or a graph, meta tags in either order, microdata."""
    k = F.col("p_partkey")
    product = F.concat(F.lit('{"@type":"Product","name":"'), "p_name", F.lit('"}'))
    ld = (
        F.when(k % 5 == 0, product)
        .when(k % 5 == 1, F.concat(F.lit('[{"x":1},'), product, F.lit("]")))
        .when(k % 5 == 2, F.concat(F.lit('{"@context":"c","@graph":['), product, F.lit("]}")))
        .when(k % 5 == 3, F.lit("{broken"))
        .otherwise("")
    )
    page = F.concat(
        F.lit('<html><head><script type="application/ld+json"> '), ld, F.lit(" </script>"),
        F.when(k % 2 == 0, F.concat(F.lit('<meta property="og:title" content="a"><meta content="'), "p_brand", F.lit('" property="og:title">'))).otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit("<meta name='twitter:card' content='"), "p_type", F.lit("'>"))).otherwise(""), F.lit("</head>"),
        F.when(k % 4 == 0, F.concat(F.lit('<div itemscope><b itemprop="name"> '), "p_name", F.lit(' </b><meta itemprop="size" content="'), "p_size", F.lit('"></div>'))).otherwise(""),
    )
    out = records.described(dealt(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("page_id"), page.alias("html")))
    return out.select(
        "page_id", F.array_join(F.transform("items", lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.lit("(graph)"))), "|").alias("items"), F.col("open_graph")["og:title"].alias("og_title"),
        F.col("twitter")["twitter:card"].alias("twitter_card"), F.col("microdata")["name"].alias("name"), F.col("microdata")["size"].alias("size"), "confidence",
    )


def nested_metadata(spark, sf_dir):
    """Items of JSON-LD with arrays in graphs in graphs, as deep as the part's number says, and microdata with an item inside."""
    k = F.col("p_partkey")
    thing = F.concat(F.lit('{"@type":"T","name":"'), "p_name", F.lit('"}'))
    deep = F.aggregate(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), thing, lambda x, n: F.concat(F.lit('{"@context":"c","n":'), n, F.lit(',"@graph":[[7,'), x, F.lit("]]}")))
    page = F.concat(
        F.lit('<script type="application/ld+json">['), deep, F.lit(',{"no":1}]</script><div itemscope><p itemprop="name"><b>'), "p_name", F.lit('</b> <i>'), "p_brand",
        F.lit('</i></p><div itemprop="offers" itemscope><span itemprop="price">'), "p_size", F.lit('</span><a itemprop="url" href="/x">y</a></div></div>'),
    )
    out = records.described(dealt(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("page_id"), page.alias("html")))
    numbers = F.transform("items", lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.n")))
    return out.select("page_id", F.array_join(numbers, "|").alias("items"), *[F.col("microdata")[n].alias(n.replace(".", "_")) for n in ("name", "offers.price", "offers.url")])


def heuristic_extractions(spark, sf_dir):
    """Title, paragraphs and confidence of each page by its best containers."""
    pages = table(spark, sf_dir, "pages")
    found = structured.score_containers(structured.containers(pages))
    best = structured.chosen_containers(found).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("element").alias("no"), "last"))).alias("best"))
    several = found.filter("candidate").groupBy("page_id").agg(F.count("*").alias("elements"))
    rows = elements.with_elements(pages.select("page_id", "url", "html"), ["p", "h1"], texts=["p", "h1"])
    rows = rows.withColumn("_p", elements.find("p")).withColumn("heading", F.coalesce(html.collapse(F.get(elements.find("h1"), F.lit(0))["text"]), F.lit("")))
    rows = rows.drop("elements", "flow").join(best, "page_id", "left").join(several, "page_id", "left")
    texts = F.flatten(F.transform("best", lambda b: F.transform(elements.inside(b, "_p"), lambda e: html.collapse(e["text"]))))
    every = F.coalesce(F.filter(texts, lambda x: F.length(x) >= 20), F.array().cast("array<string>"))
    path = F.regexp_replace("url", "^(?i)https?://[^/?#]+", "")
    heading, title = F.col("heading"), html.title(F.col("html"))
    name = F.when(heading != "", heading).when(title != "", title).otherwise(path)
    rows = rows.select("page_id", name.alias("title"), F.array_distinct(every).alias("p"), F.coalesce("elements", F.lit(0)).alias("e"))
    length = F.aggregate("p", F.lit(0), lambda n, x: n + F.length(x))
    sure = assembly.heuristic_confidence(F.size("p"), length, F.col("e"))
    return rows.select("page_id", "title", F.size("p").alias("n_paragraphs"), F.array_join("p", "\n\n").alias("content"), F.round(sure, 6).alias("confidence"))


def sql_functions(spark, sf_dir):
    """The library's functions called from SQL text."""
    registry.register(spark)
    return spark.sql(
        """SELECT page_id, sift_url_key(url) AS url_key, sift_tokens(html) AS tokens, sift_backoff(CAST(page_id % 8 AS INT), 100, 5000) AS delay_ms,
             sift_price(concat('$1,', 100 + page_id % 800, '.50')) AS price, round(sift_cosine(array(1D, page_id), array(page_id, 2D)), 6) AS likeness FROM {pages}""",
        pages=table(spark, sf_dir, "pages"),
    )


def sql_links(spark, sf_dir):
    registry.register(spark)
    return spark.sql("SELECT page_id, count(*) AS n, min(href) AS first_href FROM {pages}, LATERAL sift_links(html) GROUP BY page_id", pages=table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        captured_orders, answer_parts, answered_listings, content_addresses, span_offsets, verified_spans, text_hashes, due_watches, source_health,
        bucket_percentiles, backfill_progress, delivered_events, described_pages, nested_metadata, heuristic_extractions, sql_functions, sql_links,
    )
}

_ADDRESS = f"'sha256:' || sha256({{0}} || chr(10) || '---METADATA---' || chr(10) || '{{{{\"url\":\"' || url || '\",\"contentType\":\"text/html\"}}}}')"
_SPANS = r"""p AS (SELECT page_id, 'é日 ' || html AS html FROM pages),
t AS (SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '<(?:p)(?:\s[^>]*)?>([^<]*)', 1, 'i'), lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM p),
u AS (SELECT page_id, html, unnest(l) AS text, unnest(range(len(l)))::INTEGER AS span_no FROM t),
s AS (SELECT page_id, html, span_no, instr(html, text) - 1 AS a, length(text) AS n, text FROM u),
sp AS (SELECT page_id, span_no, html, CASE WHEN page_id % 6 = 1 THEN -1 ELSE a END::INTEGER AS "start", CASE WHEN page_id % 6 = 2 THEN 10000000 ELSE a + n END::INTEGER AS "end",
  octet_length(encode(left(html, a)))::INTEGER AS byte_start, (octet_length(encode(left(html, a))) + octet_length(encode(text)))::INTEGER AS byte_end FROM s)"""
_BOUNDS = [*map(str, operations.BUCKETS), "inf"]
_BUCKETS = ", ".join([f"count(*) FILTER (value <= {b}) AS b{k}" for k, b in enumerate(operations.BUCKETS)] + [f"count(*) AS b{len(operations.BUCKETS)}"])
_LAST = f"b{len(operations.BUCKETS)}"
ORACLE_SQL = {
    "captured_orders": """WITH i AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1)::INTEGER AS item_no FROM lineitem),
o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 7 = 0)
SELECT l_orderkey, l_orderkey::VARCHAR AS order_id, item_no, CASE WHEN l_linenumber % 2 = 0 THEN 'B0' || l_partkey ELSE l_orderkey::VARCHAR END AS item_id, 'Part ' || l_partkey AS title,
  CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice ELSE 9.5 END::DOUBLE AS price, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity ELSE 1 END::INTEGER AS quantity,
  CASE WHEN l_orderkey % 3 = 0 THEN 'sold' ELSE 'unknown' END AS availability FROM i WHERE l_orderkey % 7 > 0 AND l_linenumber % 5 > 0
UNION ALL SELECT l_orderkey, l_orderkey::VARCHAR, 0, l_orderkey::VARCHAR, 'Whole order', 9.5, 1, CASE WHEN l_orderkey % 3 = 0 THEN 'sold' ELSE 'unknown' END FROM o""",
    "answer_parts": r"""SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN source ELSE 'Untitled' END AS title, CASE WHEN doc_id % 4 > 0 THEN trim('x' || regexp_replace(text, '\s+', ' ', 'g')) ELSE 'no parts ' || doc_id END AS content,
  CASE WHEN doc_id % 4 > 0 THEN 'short of ' || source || chr(10) ELSE '' END AS summary FROM documents""",
    "answered_listings": """WITH x AS (SELECT *, p_partkey AS k, p_partkey % 6 = 2 AS odd, CASE WHEN p_partkey % 9 = 0 THEN 0.9 ELSE 1.0 END AS short FROM part WHERE p_partkey % 6 <> 1)
SELECT k AS p_partkey, CASE WHEN NOT odd THEN p_name END AS title, CASE WHEN NOT odd AND k % 3 > 0 THEN p_retailprice END AS price, CASE WHEN odd THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN odd THEN 'unknown' WHEN k % 2 = 0 THEN 'used_good' ELSE 'new' END AS condition, CASE WHEN NOT odd AND k % 4 > 0 THEN k::VARCHAR END AS item_id,
  CASE WHEN odd THEN NULL WHEN k % 5 = 0 THEN 'ebay' WHEN k % 5 = 1 THEN 'custom' END AS marketplace,
  round(greatest(0.5, least(0.8, (CASE WHEN odd THEN 0.5 * 0.5 * 0.8 * 0.9 ELSE 0.7 * CASE WHEN k % 3 > 0 THEN 1.0 ELSE 0.8 END * CASE WHEN k % 4 > 0 THEN 1.0 ELSE 0.9 END
    + CASE WHEN k % 5 < 2 THEN 0.05 ELSE 0.0 END END) * short))::DOUBLE, 6) AS confidence FROM x""",
    "content_addresses": f"""WITH c AS (SELECT page_id, url, html, {_CANON} AS canon, CASE WHEN page_id % 5 = 0 THEN html || '<p>more</p>' WHEN page_id % 5 = 1 THEN html || '  ' || chr(10) || ' <!-- note -->' ELSE html END AS later FROM pages),
h AS (SELECT page_id, url, {_ADDRESS.format("canon")} AS h, later FROM c),
n AS (SELECT page_id, h, {_ADDRESS.format("canon2")} AS h2 FROM (SELECT page_id, url, h, {_CANON} AS canon2 FROM (SELECT page_id, url, h, later AS html FROM h)))
SELECT page_id, page_id % 7 > 0 AND h = h2 AS verified, CASE WHEN page_id % 7 > 0 THEN substr(h, 8) END AS digest, page_id % 7 > 0 AND h = h2 AS same,
  CASE WHEN page_id % 7 > 0 THEN 'content:' || substr(h, 8, 16) END AS storage_key FROM n""",
    "span_offsets": f'WITH {_SPANS} SELECT page_id, span_no, "start", "end", byte_start, byte_end FROM sp',
    "verified_spans": f"""WITH {_SPANS}, v AS (SELECT page_id, page_id % 4 <> 0 AS m, "start" >= 0 AND "end" <= length(html) + (page_id % 4 = 0)::INTEGER AND "start" < "end" AS ok FROM sp)
SELECT page_id, bool_and(m) AS hash_matches, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_invalid, bool_and(m) AND bool_and(ok) AS valid FROM v GROUP BY 1""",
    "text_hashes": """WITH c AS (SELECT doc_id, list_concat([55357::BIGINT, 56832::BIGINT], flatten(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) >= 65536
  THEN [(55296 + (unicode(x) - 65536) // 1024)::BIGINT, (56320 + (unicode(x) - 65536) % 1024)::BIGINT] ELSE [unicode(x)::BIGINT] END))) AS u FROM documents),
h AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, u), lambda h, x: (h * 31 + x) % 4294967296) AS w FROM c)
SELECT doc_id, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS hash FROM h""",
    "due_watches": f"""WITH w AS (SELECT user_id, max(ts) AS t FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1), x AS (SELECT user_id, epoch(TIMESTAMP '{AS_OF}') - epoch(t) - (user_id % 5 + 1) * 3600 AS o FROM w
  WHERE user_id % 4 <> 0 AND user_id % 9 <> 0)
SELECT user_id, trunc(o)::BIGINT AS overdue FROM x WHERE o >= 0""",
    "source_health": f"""WITH r AS (SELECT event_type, value >= 10 AS ok FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100), g AS (SELECT event_type, count(*) AS total, count(*) FILTER (NOT ok) AS bad FROM r GROUP BY 1)
SELECT event_type, total, round(bad / total, 6) AS failure_rate, round(greatest(0.0, 0.85::DOUBLE - bad / total * 0.5), 6) AS reliability, (total - bad) || '/' || total || ' successful in last hour' AS message FROM g""",
    "bucket_percentiles": f"""WITH h AS (SELECT event_type, {_BUCKETS} FROM events GROUP BY 1)
SELECT event_type, CASE {" ".join(f"WHEN b{k} >= {_LAST} * 0.95 THEN '{b}'" for k, b in enumerate(_BOUNDS))} END AS bound,
  CASE {" ".join(f"WHEN {' + '.join(f'b{i}' for i in range(k + 1))} >= {_LAST} * 0.95 THEN '{b}'" for k, b in enumerate(_BOUNDS))} END AS served_bound FROM h""",
    "backfill_progress": """WITH x AS (SELECT l_suppkey, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents, row_number() OVER o - 1 AS no, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT) OVER o AS upto FROM lineitem
  WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * 100 + 0.5)::BIGINT ROWS UNBOUNDED PRECEDING))
SELECT l_suppkey, no // 50 AS batch, count(*) AS n, max(upto) / (max(no) + 1) / 100 AS mean_so_far FROM x GROUP BY 1, 2""",
    "delivered_events": """WITH x AS (SELECT event_type, user_id % 10 AS bucket, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events WHERE event_type IN ('error', 'view'))
SELECT event_type, bucket, count(*) AS n, count(v) AS n_valued, round(avg(v), 4) AS mean FROM x WHERE coalesce(v >= 50, true) GROUP BY 1, 2""",
    "nested_metadata": """SELECT p_partkey AS page_id, p_name || '|' || array_to_string(range(1, p_partkey % 4 + 2), '|') AS items, p_name || ' ' || p_brand AS name, p_size::VARCHAR AS offers_price, '/x' AS offers_url FROM part""",
    "described_pages": """SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || '|(graph)' ELSE '' END AS items, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS og_title,
  CASE WHEN p_partkey % 3 = 0 THEN p_type END AS twitter_card, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR END AS size,
  (CASE WHEN p_partkey % 5 < 3 THEN 0.4 ELSE 0.0 END::DOUBLE + CASE WHEN p_partkey % 2 = 0 THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN p_partkey % 4 = 0 THEN 0.3 ELSE 0.0 END::DOUBLE) AS confidence FROM part""",
    "heuristic_extractions": _SCORED
    + r""", g AS (SELECT page_id, tag, no, score::DOUBLE AS score, row_number() OVER o AS place, round(coalesce(sum(score::DOUBLE) OVER (PARTITION BY page_id ORDER BY score DESC, tag, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS b,
  round(sum(score::DOUBLE) OVER (PARTITION BY page_id) * 0.7, 9) AS t FROM s WHERE score > 0 AND candidate WINDOW o AS (PARTITION BY page_id ORDER BY score DESC, tag, no)),
w AS (SELECT page_id, tag, no, place FROM g WHERE b < t),
x AS (SELECT page_id, place, unnest(l) AS p, unnest(range(len(l))) AS k FROM (SELECT i.page_id, w.place, """
    + _texts_sql("p", 20).format(PIECES_SQL.replace("(html,", "(i.inner_html,"))
    + r""" AS l FROM i JOIN w USING (page_id, tag, no))),
y AS (SELECT page_id, p, min((place, k)) AS o FROM x GROUP BY 1, 2),
z AS (SELECT page_id, string_agg(p, chr(10) || chr(10) ORDER BY o) AS content, count(*) AS n, sum(length(p)) AS len FROM y GROUP BY 1),
e AS (SELECT page_id, count(*) AS e FROM i WHERE candidate GROUP BY 1),
q AS (SELECT page_id, url, coalesce("""
    + _texts_sql("h1", 0).format(PIECES_SQL)
    + r"""[1], '') AS h, trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)', 1, 'i'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN h <> '' THEN h WHEN t <> '' THEN t ELSE regexp_replace(url, '^https?://[^/?#]+', '', 'i') END AS title, coalesce(n, 0)::INTEGER AS n_paragraphs, coalesce(content, '') AS content,
  round(least(least(coalesce(n, 0) / 3, 1.0) * 0.4 + least(coalesce(len, 0) / 1000, 1.0) * 0.3 + (1 - least(coalesce(e, 0) / 10, 1.0)) * 0.3, 1.0)::DOUBLE, 6) AS confidence
FROM q LEFT JOIN z USING (page_id) LEFT JOIN e USING (page_id)""",
    "sql_functions": """SELECT page_id, left(sha256(regexp_replace(lower(trim(url)), '/+$', '')), 16) AS url_key, ceil(length(html) / 4)::BIGINT AS tokens, least(pow(2, page_id % 8) * 100, 5000)::BIGINT AS delay_ms,
  1100.5::DOUBLE + page_id % 800 AS price, round(CASE WHEN page_id = 0 THEN 0.0 ELSE (page_id + 2 * page_id) / (sqrt(1 + page_id * page_id) * sqrt(page_id * page_id + 4)) END::DOUBLE, 6) AS likeness FROM pages""",
    "sql_links": r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*"([^"]*)"', 1, 'i')) AS href FROM pages) SELECT page_id, count(*) AS n, min(href) AS first_href FROM l GROUP BY 1""",
}
