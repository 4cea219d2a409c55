"""From scored candidates to what is sent out: the completeness guard, heuristic confidence and a page's event stream."""

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import html, scoring

# Below any of these the best candidate counts as incomplete; another one needs either of the first two.
MIN_PARAGRAPHS, MIN_LENGTH, MIN_WORDS = 3, 300, 80
#: Paragraphs that an incomplete text is filled up to.
FILL_TO = 5


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def complete(scored: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(page_id, method, content, paragraph_count, action): the best candidate of each page, unless it is incomplete.

    An incomplete one gives way to the other candidate with the most paragraphs (then the longest text) that has enough
    of either; failing that, the page's own paragraphs fill it up. `paragraphs`: (page_id, texts). Candidates of a page
    are gathered once (a page has as many as there are extractors), so there is one shuffle for all steps.
    """
    fields = F.struct("composite_score", "method_no", "method", "content", "paragraph_count")
    of_page = scored.groupBy("page_id").agg(F.collect_list(fields).alias("c"))

    best = F.array_max(F.transform("c", lambda x: F.struct(x["composite_score"].alias("s"), (-x["method_no"]).alias("n"), x.alias("x"))))["x"]
    rows = of_page.select("page_id", "c", best.alias("best"))
    b = F.col("best")
    incomplete = (b["paragraph_count"] < MIN_PARAGRAPHS) | (F.length(b["content"]) < MIN_LENGTH) | (_word_count(b["content"]) < MIN_WORDS)
    others = F.filter(
        "c",
        lambda x: (x["method_no"] != b["method_no"]) & ((x["paragraph_count"] >= MIN_PARAGRAPHS) | (F.length(x["content"]) >= MIN_LENGTH)),
    )
    other = F.array_max(
        F.transform(
            others,
            lambda x: F.struct(
                x["paragraph_count"].alias("p"), F.length(x["content"]).alias("l"), (-x["method_no"]).alias("n"), x.alias("x")
            ),
        )
    )["x"]
    # The guard compares with others only where there are any; a lone candidate stays as it is.
    rows = rows.select("page_id", "best", F.when(incomplete & (F.size("c") > 1), other).alias("other"), (incomplete & (F.size("c") > 1)).alias("low"))
    rows = rows.join(paragraphs, "page_id", "left")
    fill = F.slice(F.coalesce("texts", F.array().cast("array<string>")), F.lit(1), F.greatest(FILL_TO - F.col("best.paragraph_count"), F.lit(0)))
    fill = F.when(F.col("low") & F.col("other").isNull(), fill).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_fill", fill)
    chosen = F.coalesce("other", "best")
    content = F.when(F.size("_fill") > 0, F.concat_ws("\n\n", "best.content", F.array_join("_fill", "\n\n"))).otherwise(chosen["content"])
    action = F.when(F.col("other").isNotNull(), "other").when(F.size("_fill") > 0, "filled").otherwise("kept")
    return rows.select(
        "page_id",
        chosen["method"].alias("method"),
        content.alias("content"),
        (chosen["paragraph_count"] + F.size("_fill")).alias("paragraph_count"),
        action.alias("action"),
    )


def heuristic_confidence(paragraphs: Column, length: Column, elements: Column, wanted: int = 3) -> Column:
    """How far to trust paragraphs found by heuristics: their number, their length, and how few elements were searched."""
    few = F.least(paragraphs / wanted, F.lit(1.0)) * 0.4
    size = F.least(length / 1000, F.lit(1.0)) * 0.3
    return F.least(few + size + (1 - F.least(elements / 10, F.lit(1.0))) * 0.3, F.lit(1.0))


def events(pages: DataFrame, chosen: DataFrame, nodes: DataFrame, max_nodes: int) -> DataFrame:
    """(page_id, seq, type, payload): the event stream of each page, payloads as JSON.

    metadata, an alert for each gate, confidence, extraction, one event for each of the first `max_nodes` nodes,
    provenance, done. Nodes are gathered by page (their number is what limits a page's stream); the rest is one row.
    """
    listed = F.array_sort(F.collect_list(F.struct("node_no", "text", "is_heading", "node_hash")))
    of_page = nodes.groupBy("page_id").agg(listed.alias("all"))
    rows = pages.join(chosen, "page_id").join(of_page, "page_id", "left")
    challenge, wall = html.first_reason(F.col("html"), html.CHALLENGES), html.first_reason(F.col("html"), html.WALLS)
    every = F.coalesce("all", F.expr("cast(array() AS array<struct<node_no:int,text:string,is_heading:boolean,node_hash:string>>)"))
    rows = rows.select("*", every.alias("n"), challenge.alias("challenge"), wall.alias("wall"), F.length("content").alias("n_chars"))
    fallback = F.col("method") == "stripped"
    sure = scoring.stream_confidence(F.col("n_chars"), F.lit(None).cast("string"), F.size("n"), fallback)
    sure = F.when(F.col("wall").isNotNull(), F.least(sure, F.lit(0.15))).otherwise(sure)
    rows = rows.withColumns({"sure": F.round(sure, 9), "kept": F.slice("n", 1, max_nodes), "title": html.title(F.col("html"))})

    def event(type_: str, **payload: Column) -> Column:
        return F.struct(F.lit(type_).alias("type"), F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()])).alias("payload"))

    def node(x: Column) -> Column:
        kind = F.when(x["is_heading"], "heading").otherwise("paragraph")
        trust = F.round(scoring.node_confidence(F.col("sure"), F.length(x["text"]), x["is_heading"]), 9)
        return event("node", hash=x["node_hash"], order=x["node_no"], kind=kind, text=x["text"], confidence=trust)

    def alert(kind: str, reason: str) -> Column:
        return F.when(F.col(reason).isNotNull(), event("alert", kind=F.lit(kind), reason=F.col(reason)))

    head = F.array_compact(
        F.array(
            event("metadata", url=F.col("url"), bytes=F.octet_length("html")),
            alert("challenge_detected", "challenge"),
            alert("auth_wall_detected", "wall"),
            event("confidence", overall=F.col("sure"), auth_wall=F.col("wall").isNotNull(), fallback=fallback, nodes=F.size("n"), length=F.col("n_chars")),
            event("extraction", method=F.col("method"), fallback=fallback),
        )
    )
    tail = F.array(
        event("provenance", extractor=F.col("method"), checksum=F.sha2("html", 256), nodes=F.size("kept")),
        event("done", nodes=F.size("kept"), truncated=F.size("n") > F.size("kept"), title=F.col("title")),
    )
    return rows.select("page_id", F.posexplode(F.concat(head, F.transform("kept", node), tail)).alias("seq", "e")).select(
        "page_id", "seq", "e.type", "e.payload"
    )


def markdown(lines: DataFrame) -> DataFrame:
    """(page_id, title, text) from event rows: what a reader of the stream puts together again, nodes in order."""
    n = F.get_json_object("payload", "$.text")
    mark = F.when(F.get_json_object("payload", "$.kind") == "heading", F.concat(F.lit("# "), n)).otherwise(n)
    parts = F.array_sort(F.collect_list(F.when(F.col("type") == "node", F.struct("seq", mark.alias("t")))))
    title = F.max(F.when(F.col("type") == "done", F.get_json_object("payload", "$.title")))
    rows = lines.groupBy("page_id").agg(title.alias("title"), parts.alias("p"))
    return rows.select("page_id", "title", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))
