"""Records that other programs hand over: captured orders, answers of language models, watches, metadata in pages."""

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.functions import html
from siftline.functions.running import checkpointing
from siftline.operators import elements, listings
from siftline.operators.structured import metadata

ORDER = """struct<orderId:string,orderDate:string,status:string,total:double,seller:struct<name:string>,
items:array<struct<title:string,asin:string,itemNumber:string,price:double,quantity:int,productUrl:string>>>"""
#: Bounds of the confidence that a model's answer may claim.
ANSWER_RANGE = (0.5, 0.8)


def captured_orders(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """(keep..., order_id, item_no, item_id, title, price, quantity, url, availability) of captured orders in JSON, a row
    for each item; an order without items is its own item, and items without a title are left out."""
    o = F.from_json(json, ORDER)
    own = F.get_json_object(json, "$.title")
    alone = F.array(F.struct(own.alias("title"), *[F.lit(None).cast(t).alias(n) for n, t in (("asin", "string"), ("itemNumber", "string"), ("price", "double"), ("quantity", "int"), ("productUrl", "string"))]))
    items = F.when(F.size("o.items") > 0, F.col("o.items")).otherwise(alone)
    out = rows.select(*keep, json, o.alias("o"))
    out = out.select(*keep, "o", F.posexplode(items).alias("item_no", "i")).filter(F.length("i.title") > 0)
    return out.select(
        *keep,
        F.col("o.orderId").alias("order_id"),
        "item_no",
        F.coalesce("i.asin", "i.itemNumber", "o.orderId").alias("item_id"),
        F.col("i.title").alias("title"),
        F.coalesce("i.price", "o.total").alias("price"),
        F.coalesce("i.quantity", F.lit(1)).alias("quantity"),
        F.col("i.productUrl").alias("url"),
        F.when(F.lower("o.status").contains("delivered"), "sold").otherwise("unknown").alias("availability"),
    )


def answer_parts(text: Column) -> dict[str, Column]:
    """Title, content and summary of an answer with lines TITLE:, CONTENT: and SUMMARY:."""

    def part(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(text, f"(?s){pattern}", 1)), F.lit(""))

    return {
        "title": F.coalesce(part(r"TITLE:\s*(.+?)(?:\n|CONTENT:|$)"), F.lit("Untitled")),
        "content": F.coalesce(part(r"CONTENT:\s*(.+?)(?:\n|SUMMARY:|$)"), F.trim(text)),
        "summary": F.coalesce(part(r"SUMMARY:\s*(.+?)$"), F.lit("")),
    }


def answered_listings(rows: DataFrame, answer: str, source: str, *keep: str) -> DataFrame:
    """(keep..., title, price, currency, condition, item_id, marketplace, confidence) of answers in JSON, fenced or not;
    what isn't JSON is left out, and a field of another type than it should have counts as missing."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.col(answer)), r"^```(?:json)?\n?", ""), r"\n?```$", "")
    rows = rows.withColumn("_v", F.try_parse_json(plain)).filter("_v IS NOT NULL")

    def field(name: str, numeric: bool = False) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
        fits = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") if numeric else kind == "STRING"
        return F.when(fits, F.try_variant_get("_v", f"$.{name}", "double" if numeric else "string"))

    names = ["title", "currency", "condition", "soldDate", "itemNumber", "marketplace", "url"]
    rows = rows.select(*keep, source, *[field(n).alias(f"_{n}") for n in names], field("price", True).alias("_price"), field("confidence", True).alias("_sure"))

    def missing(c: str) -> Column:
        x = F.col(c)
        return x.isNull() | (x.cast("string") == "") | ((x == 0) if c == "_price" else F.lit(False))

    sure = F.coalesce("_sure", F.lit(0.5)) * F.when(missing("_title"), 0.5).otherwise(1.0)
    sure = sure * F.when(missing("_price"), 0.8).otherwise(1.0) * F.when(missing("_itemNumber"), 0.9).otherwise(1.0)
    for there in (F.coalesce(F.col("_url").contains("http"), F.lit(False)), ~missing("_soldDate"), ~missing("_marketplace")):
        sure = sure + F.when(there, 0.05).otherwise(0.0)
    n = F.length(source)
    sure = sure * F.when(n < 500, 0.9).when(n > 50_000, 0.85).otherwise(1.0)
    lower = F.lower("_marketplace")
    name = F
    for m in ("ebay", "amazon", "walmart", "etsy"):
        name = name.when(lower.contains(m), m)
    low, high = ANSWER_RANGE
    return rows.select(
        *keep, F.col("_title").alias("title"), F.col("_price").alias("price"), F.coalesce("_currency", F.lit("USD")).alias("currency"),
        listings.condition(F.col("_condition")).alias("condition"), F.col("_itemNumber").alias("item_id"),
        name.when(~missing("_marketplace"), "custom").otherwise(F.lit(None).cast("string")).alias("marketplace"),
        F.greatest(F.lit(low), F.least(F.lit(high), sure)).alias("confidence"),
    )


def due(watches: DataFrame, as_of: Column) -> DataFrame:
    """Active watches (status, last_checked, interval in seconds) whose interval has passed, longest overdue first."""
    passed = as_of.cast("double") - F.coalesce(F.col("last_checked").cast("double"), F.lit(0.0))
    rows = watches.filter((F.col("status") == "active") & (passed >= F.col("interval")))
    return rows.withColumn("overdue", (passed - F.col("interval")).cast("long")).orderBy(F.desc("overdue"))


def source_health(calls: DataFrame, by: str, ts: str, order: str, ok: Column, as_of: Column, highest: float) -> DataFrame:
    """(by, total, failure_rate, reliability, message) of a source's calls within the last hour, the last 100 at most."""
    recent = calls.select(by, ts, order, ok.alias("_ok")).filter((F.col(ts).cast("timestamp") > as_of - F.expr("INTERVAL 1 HOUR")) & (F.col(ts).cast("timestamp") <= as_of))
    last = W.partitionBy(by).orderBy(F.desc(ts), F.desc(order))
    recent = recent.withColumn("_k", F.row_number().over(last)).filter("_k <= 100")
    out = recent.groupBy(by).agg(F.count("*").alias("total"), F.count_if(~F.col("_ok")).alias("_bad"))
    rate = F.col("_bad") / F.col("total")
    says = F.concat((F.col("total") - F.col("_bad")).cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" successful in last hour"))
    return out.select(by, "total", rate.alias("failure_rate"), F.greatest(F.lit(0.0), highest - rate * 0.5).alias("reliability"), says.alias("message"))


def json_items(pages: DataFrame) -> DataFrame:
    """(page_id, items): the JSON-LD objects of each page that have a context or a type, from arrays and `@graph`s at any
    depth, in the order of the page; what a graph holds comes before the object that holds it.

    The trees are walked level by level as narrow rows, each with its path; a level is one job, and there are as many as
    the deepest tree has. Pages without any such object have no row.
    """
    checkpointing(pages.sparkSession)
    level = metadata(pages).select("page_id", F.posexplode("json_ld").alias("at", "json")).select("page_id", F.array("at").alias("path"), "json")
    found = []
    while True:
        level = level.withColumn("json", F.trim("json")).checkpoint()
        if level.isEmpty():
            break
        whole = F.get_json_object("json", "$.@type").isNotNull() | F.get_json_object("json", "$.@context").isNotNull()
        own = F.concat("path", F.array(F.lit((1 << 31) - 1)))
        found.append(level.filter(whole & F.col("json").startswith("{")).select("page_id", own.alias("path"), "json"))
        inner = F.when(F.col("json").startswith("["), F.col("json")).otherwise(F.get_json_object("json", "$.@graph"))
        inner = F.from_json(F.when(F.trim(inner).startswith("["), inner), "array<string>")
        level = level.select("page_id", "path", F.posexplode(inner).alias("at", "json")).filter("json IS NOT NULL")
        level = level.select("page_id", F.concat("path", F.array("at")).alias("path"), "json")
    every = functools.reduce(DataFrame.union, found) if found else level
    listed = F.array_sort(F.collect_list(F.struct("path", "json")))
    return every.groupBy("page_id").agg(F.transform(listed, lambda x: x["json"]).alias("items"))


def described(pages: DataFrame) -> DataFrame:
    """(page_id, items, open_graph, twitter, microdata, confidence): what pages say of themselves.

    items: JSON-LD objects with a context or type as JSON (`json_items`). microdata: properties of elements with itemprop, the first value of each: what the element
    says in an attribute, or its whole text; a property of an item within another is named by both, as `offers.price`.
    """
    # Sizes of pages made by a query are estimates, and often far too small: both sides are shuffled, none is broadcast.
    told = metadata(elements.with_elements(pages.select("page_id", "html")), "flow", "elements")
    rows = told.join(json_items(pages).hint("merge"), "page_id", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    props = F.filter("elements", lambda e: F.map_contains_key(e["attrs"], "itemprop"))
    scopes = F.filter("props", lambda e: F.map_contains_key(e["attrs"], "itemscope"))

    def prop(e: Column) -> Column:
        outer = F.filter("scopes", lambda o: (o["no"] < e["no"]) & (e["no"] <= o["last"]))
        path = F.array_join(F.transform(F.concat(outer, F.array(e)), lambda x: x["attrs"]["itemprop"]), ".")
        given = F.coalesce(*[F.nullif(e["attrs"][a], F.lit("")) for a in ("content", "href", "src")])
        return F.struct(path.alias("k"), F.coalesce(given, html.collapse(elements.text_of(e))).alias("v"))

    keep = ["page_id", items.alias("items"), "open_graph", "twitter", "flow"]
    rows = elements.settled(rows, keep, props=props)
    rows = elements.settled(rows, [*keep[:1], "items", *keep[2:], "props"], scopes=scopes)
    pairs = F.transform(F.filter("props", lambda e: ~F.map_contains_key(e["attrs"], "itemscope")), prop)
    rows = elements.settled(rows, ["page_id", "items", "open_graph", "twitter"], pairs=pairs)
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    micro = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter("pairs", lambda p: p["k"] == k), 1)["v"]))
    rows = elements.settled(rows, ["page_id", "items", "open_graph", "twitter"], microdata=micro)
    sure = F.when(F.size("items") > 0, 0.4).otherwise(0.0) + F.when(F.size("open_graph") > 0, 0.3).otherwise(0.0) + F.when(F.size("microdata") > 0, 0.3).otherwise(0.0)
    return rows.withColumn("confidence", sure)

