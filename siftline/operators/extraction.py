"""Competing extractions of a page, their scores, the best one and why."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.functions import html, scoring
from siftline.operators import elements

#: Order in which extractors are asked, which decides ties, with the confidence each has in itself.
METHODS = {"reader": 0.9, "paragraphs": 0.6, "stripped": 0.3}
#: Characters that a paragraph of an article has at least.
MIN_TEXT = 20
#: Elements that are nodes of a page.
NODES = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")

# Page types with the weights of their signals; scores add up, the first largest type counts.
PAGE_SIGNALS = [
    ("login", 0.3, "title", r"log\s*in|sign\s*in"),
    ("login", 0.2, "url", "login|signin|auth"),
    ("search-results", 0.3, "head", "search|results"),
    ("search-results", 0.3, "url", "[?&]q=|[?&]query=|[?&]search="),
    ("article", 0.3, "html", '<article|class="article|role="article"'),
    ("article", 0.2, "html", "byline|author|published"),
    ("product", 0.3, "html", r"price|add.to.cart|buy.now|\$\d+"),
    ("product", 0.2, "url", "product|item|sku"),
    ("checkout", 0.4, "html", "checkout|payment|billing|shipping address"),
    ("dashboard", 0.3, "named", "dashboard|admin|panel|overview"),
    ("listing", 0.3, "url", "listing|catalog|browse|category"),
    ("error", 0.4, "title", "404|not found|error|forbidden|500"),
]
PAGE_TYPES = list(dict.fromkeys(t for t, *_ in PAGE_SIGNALS))


def paragraphs(pages: DataFrame) -> DataFrame:
    """`pages` with `texts`, the whole text of each `<p>` that has any, `inner`, those of 20 characters and more that stand
    in the first `<article>`, and `heading`, the text of the first `<h1>`."""
    rows = elements.with_elements(pages, ["article", "h1", "p"], texts=["h1", "p"])
    article = F.get(elements.find("article"), F.lit(0))

    def texts(found: Column, least: int) -> Column:
        return F.filter(F.transform(found, lambda e: html.collapse(e["text"])), lambda x: F.length(x) >= least)

    return rows.withColumns(
        {
            "texts": texts(elements.find("p"), 1),
            "inner": F.coalesce(texts(elements.inside(article, elements.find("p")), MIN_TEXT), F.array().cast("array<string>")),
            "heading": F.coalesce(html.collapse(F.get(elements.find("h1"), F.lit(0))["text"]), F.lit("")),
        }
    ).drop("flow", "elements")


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, url, method, method_no, title, content, paragraph_count, confidence): a row for each extractor."""
    base = paragraphs(pages.select("page_id", "url", "html")).withColumns({"_title": html.title(F.col("html")), "_in": F.col("inner"), "_all": F.col("texts"), "_h1": F.col("heading")})
    made = {
        "reader": (F.when(F.col("_h1") != "", F.col("_h1")).otherwise(F.col("_title")), F.array_join("_in", "\n\n"), F.size("_in")),
        "paragraphs": (F.col("_title"), F.array_join("_all", "\n\n"), F.size("_all")),
        "stripped": (F.col("_title"), html.strip_html(F.col("html")), F.lit(1)),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("method"), F.lit(k).alias("method_no"), made[name][0].alias("title"),
                made[name][1].alias("content"), made[name][2].alias("paragraph_count"), F.lit(c).alias("confidence"),
            )
            for k, (name, c) in enumerate(METHODS.items())
        ]
    )
    return base.select("page_id", "url", F.inline(rows))


def score_candidates(rows: DataFrame) -> DataFrame:
    """Add the five partial scores and the composite one."""
    none = F.lit(None).cast("string")
    out = rows.withColumns(
        {
            "length_score": scoring.length_score(F.col("content")),
            "structure_score": scoring.structure_score(F.col("paragraph_count")),
            "metadata_score": scoring.metadata_score(F.col("title"), none, none),
            "density_score": scoring.density_score(F.col("content")),
            "extractor_score": F.coalesce("confidence", F.lit(scoring.PRIOR)),
        }
    )
    parts = ["length_score", "structure_score", "metadata_score", "density_score", "extractor_score"]
    return out.withColumn("composite_score", scoring.ensemble_score(*map(F.col, parts)))


def select_best(scored: DataFrame) -> DataFrame:
    """The candidate with the highest composite score of each page (ties: the extractor asked first) and the reasons.

    One shuffle by page; a page has as many rows as extractors.
    """
    order = W.partitionBy("page_id").orderBy(F.desc("composite_score"), "method_no")
    ranked = scored.withColumns(
        {
            "_rank": F.row_number().over(order),
            "_next": F.lead("method").over(order),
            "_gap": F.col("composite_score") - F.lead("composite_score").over(order),
        }
    ).filter("_rank = 1")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("length_score") >= 0.9, "optimal content length"),
            F.when(F.col("structure_score") >= 0.9, "excellent structure"),
            F.when(F.col("metadata_score") >= 0.8, "complete metadata"),
            F.when(F.col("extractor_score") >= 0.8, "high extractor confidence"),
            F.when(F.col("_gap") > 0.2, F.concat(F.lit("significantly better than "), F.col("_next"))).when(
                F.col("_gap") > 0.1, F.concat(F.lit("moderately better than "), F.col("_next"))
            ),
        )
    )
    why = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("highest composite score")
    score = scoring.three_digits(F.col("composite_score"))
    text = F.concat(F.lit("Selected "), F.col("method"), F.lit(": "), why, F.lit(" (score: "), score, F.lit(")"))
    return ranked.withColumn("explanation", text).drop("_rank", "_next", "_gap")


def gathered(scored: DataFrame) -> DataFrame:
    """(page_id, c): the candidates of each page in one array, as many as there are extractors."""
    fields = ["method_no", "method", "url", "title", "content", "paragraph_count", "extractor_score", "composite_score"]
    return scored.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _spread(values: Column) -> Column:
    """Population variance."""
    return _mean(F.transform(values, lambda x: (x - _mean(values)) * (x - _mean(values))))


def agreement(c: Column) -> Column:
    """Agreement of a page's candidates in titles, lengths and scores.

    Titles without words longer than two characters are alike to nothing (similarity 0).
    """

    def words(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(x["title"]), r"\s+"), lambda w: F.length(w) > 2))

    def alike(x: Column, y: Column) -> Column:
        both, all_ = F.size(F.array_intersect(words(x), words(y))), F.size(F.array_union(words(x), words(y)))
        return F.when(all_ > 0, both / all_).otherwise(0.0)

    pairs = F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: y["method_no"] > x["method_no"]), lambda y: alike(x, y))))
    lengths = F.transform(c, lambda x: F.length(x["content"]).cast("double"))
    scores = F.transform(c, lambda x: x["composite_score"])
    value = _mean(pairs) * 0.4 + 0.3 / (1 + _spread(lengths) / 10000) + 0.3 / (1 + _spread(scores))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def consensus(scored: DataFrame) -> DataFrame:
    """(page_id, consensus) of pages with several candidates."""
    return gathered(scored).filter(F.size("c") > 1).select("page_id", agreement(F.col("c")).alias("consensus"))


def confidence(scored: DataFrame) -> DataFrame:
    """The breakdown of a page's confidence and its log-odds combination, of pages with several candidates.

    Candidates are scored and gathered once; the best one and their agreement are read from the same array.
    """
    best = F.array_max(F.transform("c", lambda x: F.struct(x["composite_score"].alias("s"), (-x["method_no"]).alias("n"), x.alias("x"))))["x"]
    rows = gathered(scored).filter(F.size("c") > 1).select("page_id", best.alias("b"), agreement(F.col("c")).alias("consensus"))
    none = F.lit(None).cast("string")
    rows = rows.select(
        "page_id",
        F.col("b.extractor_score").alias("extraction"),
        scoring.content_quality(F.col("b.content"), F.col("b.paragraph_count")).alias("quality"),
        scoring.metadata_quality(F.col("b.title"), none, none, F.substring("b.content", 1, 200)).alias("metadata"),
        scoring.source_credibility(F.col("b.url")).alias("credibility"),
        "consensus",
    )
    names = ["extraction", "quality", "metadata", "credibility", "consensus"]
    return rows.withColumn("overall", scoring.bayes_combine(**{n: F.col(n) for n in names}))


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, node_no, text, is_heading, confidence, node_hash): paragraphs, list items and headings of a page in document
    order, each with its whole text, links written as `label (link: href)`.

    Nodes without text are left out but keep their number.
    """
    rows = elements.with_elements(pages.select("page_id", "url", "html"), NODES, texts=NODES)
    rows = rows.select("page_id", "url", F.posexplode("elements").alias("node_no", "_e"))
    rows = rows.withColumn("text", html.collapse(F.col("_e.linked"))).filter(F.length("text") > 0)
    rows = rows.withColumn("is_heading", F.col("_e.tag").startswith("h"))
    sure = scoring.node_confidence(F.lit(0.62), F.length("text"), F.col("is_heading"))
    label = F.concat_ws(":", "url", F.col("node_no").cast("string"), F.substring("text", 1, 64))
    return rows.select("page_id", "node_no", "text", "is_heading", sure.alias("confidence"), F.sha2(label, 256).alias("node_hash"))


def observations(pages: DataFrame) -> DataFrame:
    """(page_id, links, headings, n_links, n_inputs, n_images): what an agent is told of a page: the first twenty links of its
    first navigation, its first ten headings that have text, and counts."""
    rows = elements.with_elements(pages.select("page_id", "html"), ["nav", *NODES[2:], "a", "input", "select", "textarea", "img"], texts=[*NODES[2:], "a"])
    nav = F.get(elements.find("nav"), F.lit(0))
    said = lambda e: html.collapse(e["text"])
    links = F.coalesce(F.transform(elements.inside(nav, elements.find("a")), said), F.array().cast("array<string>"))
    headings = F.filter(F.transform(elements.find(" ".join(NODES[2:])), said), lambda x: x != "")
    return rows.select(
        "page_id", F.array_join(F.slice(links, 1, 20), "|").alias("links"), F.array_join(F.slice(headings, 1, 10), "|").alias("headings"),
        F.size(elements.find("a")).alias("n_links"), F.size(elements.find("input select textarea")).alias("n_inputs"), F.size(elements.find("img")).alias("n_images"),
    )


def page_types(pages: DataFrame) -> DataFrame:
    """(page_id, page_type, confidence) by the signals in a page's title, URL and first 10,000 characters."""
    rows = pages.select(
        "page_id",
        F.lower(F.substring("html", 1, 10000)).alias("html"),
        F.lower(html.title(F.col("html"))).alias("title"),
        F.lower("url").alias("url"),
    )
    rows = rows.withColumn("named", F.concat_ws(" ", "title", "url"))
    rows = rows.withColumn("head", F.concat_ws(" ", "title", "html"))
    scores = {
        t: sum((F.when(F.col(where).rlike(p), w).otherwise(0.0) for k, w, where, p in PAGE_SIGNALS if k == t), F.lit(0.0))
        for t in PAGE_TYPES
    }
    rows = rows.select("page_id", *[s.alias(f"s_{k}") for k, s in enumerate(scores.values())])
    best = F.greatest(*[F.col(f"s_{k}") for k in range(len(PAGE_TYPES))])
    kind = F
    for k, t in enumerate(PAGE_TYPES):
        kind = kind.when((F.col(f"s_{k}") == best) & (best > 0), t)
    sure = F.least(F.greatest(best, F.lit(0.1)), F.lit(0.95))
    return rows.select("page_id", kind.otherwise("unknown").alias("page_type"), F.round(sure, 9).alias("confidence"))
