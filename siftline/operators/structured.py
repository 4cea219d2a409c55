"""Structured parts of a page: containers and their scores, metadata, tables, and the policy that applies to it."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.operators import elements

# Containers that are looked at, and names that speak against or for one.
CONTAINERS = ("article", "main", "section", "nav", "aside", "footer", "div")
SEMANTIC = ("article", "main", "section")
DIVIDED = ("div", "article", "section")
BAD_NAMES = ("nav", "menu", "sidebar", "footer", "header", "ad", "comment", "social", "share")
GOOD_NAMES = ("article", "content", "post", "story", "main")
MAX_TABLES, MAX_ROWS, MAX_LINKED = 50, 500, 0.4


def containers(pages: DataFrame) -> DataFrame:
    """(page_id, tag, no, element, last, names, candidate, length, paragraphs, linked): the containers of a page at any depth.

    `no` counts those of a tag, `element` and `last` are the interval of elements inside. What is inside is counted by
    running sums over a page's elements: the sum at a container's last element less that at its first. Candidates are
    the articles, main parts, sections and what is named content; on pages without any the divisions.
    """
    rows = elements.with_elements(pages.select("page_id", "html")).select("page_id", F.inline("elements"))
    order = W.partitionBy("page_id").orderBy("no")
    names = F.lower(F.concat_ws(" ", F.col("attrs")["class"], F.col("attrs")["id"]))
    content = F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), "content")
    named = content | (F.coalesce(F.col("attrs")["id"], F.lit("")) == "content") | (F.coalesce(F.col("attrs")["role"], F.lit("")) == "main")
    size = F.col("end") - F.col("start")
    rows = rows.select(
        "page_id", "tag", "no", "last", names.alias("names"), (named | F.col("tag").isin(*SEMANTIC)).alias("semantic"), size.alias("length"),
        F.sum((F.col("tag") == "p").cast("int")).over(order).alias("p"), F.sum(F.when(F.col("tag") == "a", size).otherwise(0)).over(order).alias("a"),
    )
    held = rows.filter(F.col("tag").isin(*CONTAINERS) | F.col("semantic"))
    of_page = W.partitionBy("page_id")
    divided = ~F.max("semantic").over(of_page) & F.col("tag").isin(*DIVIDED)
    held = held.withColumn("candidate", F.col("semantic") | divided)
    held = held.withColumn("at", F.row_number().over(W.partitionBy("page_id", "tag").orderBy("no")) - 1)
    ends = rows.select("page_id", F.col("no").alias("last"), F.col("p").alias("p_end"), F.col("a").alias("a_end"))
    inside = [(F.col("p_end") - F.col("p")).cast("int").alias("paragraphs"), (F.col("a_end") - F.col("a")).cast("int").alias("linked")]
    return held.join(ends, ["page_id", "last"]).select("page_id", "tag", F.col("at").alias("no"), F.col("no").alias("element"), "last", "names", "candidate", "length", *inside)


def score_containers(rows: DataFrame) -> DataFrame:
    """Text length (5 at most), two points for each paragraph, minus ten times the share of link text, and names."""
    named = sum((F.when(F.col("names").contains(n), -5).otherwise(0) for n in BAD_NAMES), F.lit(0))
    named = named + sum((F.when(F.col("names").contains(n), 3).otherwise(0) for n in GOOD_NAMES), F.lit(0))
    density = F.when(F.col("length") > 0, F.col("linked") / F.col("length")).otherwise(0.0)
    return rows.withColumn("score", F.least(F.col("length") / 1000, F.lit(5.0)) + F.col("paragraphs") * 2 - density * 10 + named)


def chosen_containers(scored: DataFrame, share: float = 0.7) -> DataFrame:
    """The best candidates of each page, until their scores reach `share` of all positive ones."""
    order = W.partitionBy("page_id").orderBy(F.desc("score"), "element")
    good = scored.filter("score > 0 AND candidate")
    before = F.coalesce(F.sum("score").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("score").over(W.partitionBy("page_id"))
    ranked = good.withColumns({"_before": F.round(before, 9), "_total": F.round(total * share, 9), "place": F.row_number().over(order)})
    return ranked.filter("_before < _total").drop("_before", "_total")


def metadata(pages: DataFrame, *keep: str) -> DataFrame:
    """(page_id, keep..., json_ld, open_graph, twitter, confidence): JSON-LD scripts that parse, and meta tags as maps.

    Of a repeated property the last value counts. Attributes may stand in either order.
    """
    scripts = F.regexp_extract_all("html", F.lit(r"""(?i)<script[^>]*application/ld\+json[^>]*>([\s\S]*?)</script>"""), F.lit(1))
    json = F.filter(F.transform(scripts, lambda x: F.trim(x)), lambda x: F.try_parse_json(x).isNotNull())
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0))

    def attribute(tag: Column, names: str) -> Column:
        return F.regexp_extract(tag, rf"""(?i)\b(?:{names})\s*=\s*("[^"]*"|'[^']*')""", 1)

    def bare(x: Column) -> Column:
        return F.substring(x, F.lit(2), F.length(x) - 2)

    pairs = F.transform(tags, lambda t: F.struct(F.lower(bare(attribute(t, "property|name"))).alias("k"), bare(attribute(t, "content")).alias("v")))

    def group(prefix: str) -> Column:
        mine = F.filter(pairs, lambda p: p["k"].startswith(prefix))
        keys = F.array_distinct(F.transform(mine, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(mine, lambda p: p["k"] == k), -1)["v"]))

    rows = pages.select("page_id", *keep, json.alias("json_ld"), group("og:").alias("open_graph"), group("twitter:").alias("twitter"))
    sure = F.when(F.size("json_ld") > 0, 0.4).otherwise(0.0) + F.when(F.size("open_graph") > 0, 0.3).when(F.size("twitter") > 0, 0.1).otherwise(0.0)
    return rows.withColumn("confidence", sure)


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, caption, values): the rows of each outermost table as maps from header to cell.

    Headers are the cells of `<thead>`'s first row, or else those of the table's first row, if they are all `<th>` or
    there are further rows. Rows are those of the body, or all that aren't in the head. Cells without a header, beyond
    the last one or under an empty one, are `column_N`; of equal headers all but the first get their number; rows
    without text go. Tables of mostly link text and long ones of a single column are layout.
    """
    parts = ["table", "caption", "thead", "tbody", "tr", "td", "th", "a"]
    rows = elements.with_elements(pages.select("page_id", "html"), texts=["caption", "td", "th"])
    rows = rows.select("page_id", "elements", elements.find("table").alias("every"))
    held = F.transform(F.slice("every", 1, MAX_TABLES), lambda t, k: F.struct(k.alias("table_no"), t.alias("t")))
    outermost = F.filter(held, lambda x: ~F.exists("every", lambda o: (o["no"] < x["t"]["no"]) & (x["t"]["no"] <= o["last"])))
    whole = F.transform(outermost, lambda x: F.struct(x["table_no"], x["t"], elements.contents(x["t"]).alias("every")))
    rows = rows.select("page_id", F.inline(whole)).withColumn("e", F.filter("every", lambda e: e["tag"].isin(*parts)))
    size = F.col("t.end") - F.col("t.start")
    linked = F.aggregate(elements.find("a", "e"), F.lit(0), lambda n, a: n + a["end"] - a["start"])

    def first(tags: str) -> Column:
        return F.get(elements.find(tags, "e"), F.lit(0))

    def cells(row: Column, tags: str = "td th") -> Column:
        # `every` begins with the element after the table's own.
        own = F.slice("every", row["no"] - F.col("t.no") + 1, row["last"] - row["no"])
        return elements.find(tags, own)

    found = {"trs": elements.find("tr", "e"), "head": first("thead"), "body": first("tbody"), "caption": F.trim(first("caption")["text"])}
    rows = elements.settled(rows, ["page_id", "table_no", "t", "every"], **found, linked=linked)
    top = F.get("trs", F.lit(0))
    layout = (F.size("trs") >= 10) & (F.size(cells(top)) <= 1)
    rows = rows.filter((size > 0) & (F.col("linked") / size <= MAX_LINKED) & ~layout)
    head_row = F.get(F.filter("trs", lambda r: (r["no"] > F.col("head.no")) & (r["no"] <= F.col("head.last"))), F.lit(0))
    in_head, in_top = cells(head_row, "th"), cells(top)
    counted = F.when(F.col("body").isNull(), F.size("trs")).otherwise(F.size(elements.inside(F.col("body"), "trs")))
    headers = F.when(F.size(in_head) > 0, in_head).when(F.forall(in_top, lambda c: c["tag"] == "th") | (counted > 1), in_top)
    data = F.when(F.col("head").isNull(), F.slice("trs", F.lit(2), F.greatest(F.size("trs") - 1, F.lit(0))))
    data = data.when(F.col("body").isNotNull(), elements.inside(F.col("body"), "trs"))
    data = data.otherwise(F.filter("trs", lambda r: ~((r["no"] > F.col("head.no")) & (r["no"] <= F.col("head.last")))))
    head_texts = F.transform(headers, lambda h: F.trim(h["text"]))
    rows = elements.settled(rows, ["page_id", "table_no", "caption", "every", "t"], h=head_texts, d=F.slice(data, 1, MAX_ROWS))
    texts = F.transform("d", lambda r: F.transform(cells(r), lambda c: F.trim(c["text"])))
    rows = rows.filter(F.size("h") > 0).select("page_id", "table_no", "caption", "h", F.posexplode(texts).alias("row_no", "_c"))
    number = lambda k: (k + 1).cast("string")

    def key(k: Column) -> Column:
        h = F.nullif(F.get("h", k), F.lit(""))
        again = F.when(F.array_position("h", h) == k + 1, h).otherwise(F.concat(h, F.lit("_"), number(k)))
        return F.coalesce(again, F.concat(F.lit("column_"), number(k)))

    keys = F.transform("_c", lambda c, k: key(k))
    rows = rows.filter(F.exists("_c", lambda c: c != "")).withColumn("_k", keys)
    names = F.array_distinct("_k")
    last = F.transform(names, lambda n: F.element_at(F.filter(F.arrays_zip("_k", "_c"), lambda x: x["_k"] == n), -1)["_c"])
    return rows.select("page_id", "table_no", "row_no", "caption", F.map_from_arrays(names, last).alias("values"))


def policy(url: Column, policies: list[tuple[str, str]], default: str) -> Column:
    """The first policy whose pattern its host matches. A pattern a|b anchors a at the start and b at the end only."""
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    out = F
    for name, glob in policies:
        out = out.when(host.rlike("^" + glob.replace(".", r"\.").replace("*", ".*") + "$"), F.lit(name))
    return out.otherwise(F.lit(default))


def check_fields(rows: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Add `violations`: fields that are missing, too short, too long or of another pattern than their rule."""
    found = []
    for c, rule in rules.items():
        x = F.col(c)
        empty = x.isNull() | (x == "")
        if rule.get("required"):
            found.append(F.when(empty, f"{c} is required"))
        if "min" in rule:
            found.append(F.when(~empty & (F.length(x) < rule["min"]), f"{c} is too short"))
        if "max" in rule:
            found.append(F.when(~empty & (F.length(x) > rule["max"]), f"{c} is too long"))
        if "pattern" in rule:
            found.append(F.when(~empty & ~x.rlike(rule["pattern"]), f"{c} has another form"))
    return rows.withColumn("violations", F.array_compact(F.array(*found)))
