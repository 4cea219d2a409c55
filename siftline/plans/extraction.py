"""Queries on pages: candidates, scores, confidence, nodes, walls and page types."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.functions import html, scoring
from siftline.operators import extraction
from siftline.operators.extraction import PAGE_SIGNALS, PAGE_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows. Texts in fewer splits than there are cores, so a small table in one file, are dealt over all of them,
    as matching patterns costs far more than moving a few megabytes; larger tables stay as they are."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    few = name in ("pages", "documents") and rows.rdd.getNumPartitions() < cores
    return rows.repartition(cores) if few else rows


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by keys, where few bytes are much work: pages are to be written from them and read."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def extraction_scores(spark, sf_dir):
    scored = extraction.score_candidates(extraction.candidates(table(spark, sf_dir, "pages")))
    return scored.select(
        "page_id", "method", "paragraph_count", "length_score", "structure_score", "metadata_score", "density_score",
        F.round("composite_score", 9).alias("composite_score"),
    )


def select_best_extraction(spark, sf_dir):
    scored = extraction.score_candidates(extraction.candidates(table(spark, sf_dir, "pages")))
    best = extraction.select_best(scored)
    return best.select("page_id", "url", "method", "title", F.round("composite_score", 9).alias("composite_score"), "explanation")


def confidence_breakdown(spark, sf_dir):
    scored = extraction.score_candidates(extraction.candidates(table(spark, sf_dir, "pages")))
    rows = extraction.confidence(scored)
    return rows.select("page_id", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


def stream_confidence(spark, sf_dir):
    scored = extraction.score_candidates(extraction.candidates(table(spark, sf_dir, "pages")))
    best = extraction.select_best(scored)
    gated = html.first_reason(F.col("content"), html.WALLS).isNotNull()
    sure = scoring.stream_confidence(F.length("content"), F.lit(None).cast("string"), F.col("paragraph_count"), F.col("method") == "stripped")
    capped = F.when(gated, F.least(sure, F.lit(0.15))).otherwise(sure)
    return best.select("page_id", "method", F.round(capped, 9).alias("confidence"))


def page_nodes(spark, sf_dir):
    rows = extraction.nodes(table(spark, sf_dir, "pages"))
    return rows.withColumn("confidence", F.round("confidence", 9))


def gated_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    challenge, wall = html.first_reason(F.col("body"), html.CHALLENGES), html.first_reason(F.col("body"), html.WALLS)
    both = pages.union(docs).select("kind", "id", challenge.alias("challenge"), wall.alias("wall"))
    return both.withColumn("is_gated", F.col("challenge").isNotNull() | F.col("wall").isNotNull())


def page_types(spark, sf_dir):
    return extraction.page_types(table(spark, sf_dir, "pages"))


def _signal_sql(t: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({where}, '{p}') THEN {w} ELSE 0.0 END" for k, w, where, p in PAGE_SIGNALS if k == t)


_STRIP = "html"
for _p, _r in ((r"<script[\s\S]*?</script>", ""), (r"<style[\s\S]*?</style>", "")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '{_r}', 'gi')"
_STRIP = f"regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"
STRIP_SQL = rf"trim(regexp_replace({_STRIP}, '\s+', ' ', 'g'))"
# Elements by another route: the page is cut before every tag of a block, so a piece that begins with the start tag of one
# holds its text, as long as no block stands within another's text, as is so in these pages.
_CUTS = "p|li|h[1-6]|div|article|nav|footer|ul|body|html|head|title|style|script"
PIECES_SQL = rf"string_split(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '<(/?(?:{_CUTS})[\s>])', chr(1) || '<\1', 'gi'), chr(1))"


def decoded_sql(x: str, collapsed: bool = True) -> str:
    """Text of a piece: no tags, characters for references, white space collapsed."""
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("nbsp", " ")):
        x = f"replace({x}, '&{name};', '{char}')"
    x = f"regexp_replace({x}, '&amp;?', '&', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))" if collapsed else x


def _texts_sql(tag: str, least: int) -> str:
    return rf"list_filter(list_transform(list_filter({{0}}, lambda x: regexp_matches(x, '^<{tag}[\s>]', 'i')), lambda x: {decoded_sql('x')}), lambda x: length(x) >= {least})"


_LINKS = r"""regexp_replace(x, '<a\s[^>]*href="([^"]*)"[^>]*>\s*([^<]*?)\s*</a>', '\2 (link: \1)', 'gi')"""
NODE_SQL = rf"""node0 AS (
  SELECT page_id, url, unnest(l) AS x, unnest(range(len(l)))::INTEGER AS node_no
  FROM (SELECT page_id, url, list_filter({PIECES_SQL}, lambda x: regexp_matches(x, '^<(p|li|h[1-6])[\s>]', 'i')) AS l FROM pages)
), node AS (
  SELECT page_id, url, node_no, {decoded_sql(_LINKS)} AS text, regexp_matches(x, '^<h[1-6]', 'i') AS heading FROM node0
)"""
_TITLE = r"trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)', 1, 'i'), '\s+', ' ', 'g'))"

SCORED_SQL = rf"""
base AS (
  SELECT page_id, url, html, {_TITLE} AS t,
    coalesce({_texts_sql("h1", 0).format("pieces")}[1], '') AS h1, {_texts_sql("p", 1).format("pieces")} AS every,
    {_texts_sql("p", extraction.MIN_TEXT).format("within")} AS inside
  FROM (SELECT *, list_slice(pieces, list_position(list_transform(pieces, lambda x: regexp_matches(x, '^<article[\s>]', 'i')), true),
    list_position(list_transform(pieces, lambda x: regexp_matches(x, '^</article', 'i')), true)) AS within
    FROM (SELECT page_id, url, html, {PIECES_SQL} AS pieces FROM pages))
), cand AS (
  SELECT page_id, url, 'reader' AS method, 0 AS no, CASE WHEN h1 <> '' THEN h1 ELSE t END AS title,
    array_to_string(inside, chr(10) || chr(10)) AS content, len(inside) AS paragraph_count, 0.9 AS confidence FROM base
  UNION ALL SELECT page_id, url, 'paragraphs', 1, t, array_to_string(every, chr(10) || chr(10)), len(every), 0.6 FROM base
  UNION ALL SELECT page_id, url, 'stripped', 2, t, {STRIP_SQL}, 1, 0.3 FROM base
), parts AS (
  SELECT *, length(content) AS n, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS words FROM cand
), partial AS (
  SELECT *,
    CASE WHEN n < 100 THEN 0.1 WHEN n < 300 THEN 0.5 WHEN n <= 3000 THEN 1.0 WHEN n <= 5000 THEN 0.9 WHEN n <= 10000 THEN 0.7 ELSE 0.5 END::DOUBLE AS length_score,
    CASE WHEN paragraph_count = 0 THEN 0.1 WHEN paragraph_count BETWEEN 3 AND 20 THEN 1.0 WHEN paragraph_count >= 2 THEN 0.8 WHEN paragraph_count >= 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS structure_score,
    CASE WHEN length(title) > 5 THEN 0.4 ELSE 0.0 END::DOUBLE AS metadata_score,
    CASE WHEN n = 0 THEN 0.0 WHEN words = 0 THEN 0.4 WHEN n / words BETWEEN 5 AND 8 THEN 1.0 WHEN n / words >= 4 AND n / words < 5 THEN 0.9
      WHEN n / words > 8 AND n / words <= 10 THEN 0.9 WHEN n / words >= 3 AND n / words < 4 THEN 0.7
      WHEN n / words > 10 AND n / words <= 15 THEN 0.6 ELSE 0.4 END::DOUBLE AS density_score
  FROM parts
), scored AS (
  SELECT *, length_score * 0.20::DOUBLE + structure_score * 0.30::DOUBLE + metadata_score * 0.20::DOUBLE + density_score * 0.15::DOUBLE
    + confidence::DOUBLE * 0.15::DOUBLE AS composite
  FROM partial
), ranked AS (
  SELECT *, row_number() OVER o AS k, lead(method) OVER o AS rival, composite - lead(composite) OVER o AS gap
  FROM scored WINDOW o AS (PARTITION BY page_id ORDER BY composite DESC, no)
), best AS (
  SELECT * FROM ranked WHERE k = 1
)"""
_WALL = " ".join(rf"WHEN regexp_matches(left(content, 4096), '{p}', 'i') THEN 1" for p, _ in html.WALLS)


def _reason_sql(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(left(body, 4096), '{p}', 'i') THEN '{r}'" for p, r in patterns) + " END"


QUERIES = {
    f.__name__: f
    for f in (extraction_scores, select_best_extraction, confidence_breakdown, stream_confidence, page_nodes, gated_pages, page_types)
}
ORACLE_SQL = {
    "extraction_scores": f"WITH {SCORED_SQL} SELECT page_id, method, paragraph_count::INTEGER AS paragraph_count, length_score, structure_score, metadata_score, density_score, round(composite, 9) AS composite_score FROM scored",
    "select_best_extraction": f"""WITH {SCORED_SQL}, why AS (
  SELECT *, list_filter([
    CASE WHEN length_score >= 0.9 THEN 'optimal content length' END, CASE WHEN structure_score >= 0.9 THEN 'excellent structure' END,
    CASE WHEN metadata_score >= 0.8 THEN 'complete metadata' END, CASE WHEN confidence >= 0.8 THEN 'high extractor confidence' END,
    CASE WHEN gap > 0.2 THEN 'significantly better than ' || rival WHEN gap > 0.1 THEN 'moderately better than ' || rival END
  ], lambda x: x IS NOT NULL) AS r, floor(composite * 1000 + 0.5)::BIGINT AS m FROM best)
SELECT page_id, url, method, title, round(composite, 9) AS composite_score, 'Selected ' || method || ': '
  || CASE WHEN len(r) > 0 THEN array_to_string(r, ', ') ELSE 'highest composite score' END
  || ' (score: ' || (m // 1000)::VARCHAR || '.' || lpad((m % 1000)::VARCHAR, 3, '0') || ')' AS explanation FROM why""",
    "confidence_breakdown": rf"""WITH {SCORED_SQL}, sets AS (
  SELECT page_id, no, list_distinct(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda w: length(w) > 2)) AS w FROM scored
), alike AS (
  SELECT a.page_id, avg(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0
    THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0.0 END) AS s
  FROM sets a JOIN sets b ON a.page_id = b.page_id AND a.no < b.no GROUP BY 1
), spread AS (
  SELECT page_id, var_pop(n) AS vl, var_pop(composite) AS vs FROM scored GROUP BY 1
), parts2 AS (
  SELECT page_id, confidence::DOUBLE AS extraction,
    least(CASE WHEN n < 100 THEN 0.1 WHEN n < 300 THEN 0.3 WHEN n <= 3000 THEN 0.5 WHEN n <= 5000 THEN 0.4 ELSE 0.2 END
      + CASE WHEN paragraph_count BETWEEN 3 AND 20 THEN 0.5 WHEN paragraph_count >= 2 THEN 0.3 WHEN paragraph_count >= 1 THEN 0.2 ELSE 0.1 END, 1.0)::DOUBLE AS quality,
    (CASE WHEN length(title) > 5 AND title <> 'Unknown' THEN 0.4 ELSE 0.0 END + CASE WHEN n > 20 THEN 0.1 ELSE 0.0 END)::DOUBLE AS metadata,
    CASE WHEN regexp_matches(h, 'nytimes\.com|bbc\.com|reuters\.com|apnews\.com') THEN 0.9 WHEN regexp_matches(h, '\.(edu|gov)$') THEN 0.85
      WHEN regexp_matches(h, 'techcrunch\.com|arstechnica\.com|theverge\.com') THEN 0.8 WHEN regexp_matches(h, 'medium\.com|substack\.com') THEN 0.6 ELSE 0.5 END::DOUBLE AS credibility,
    least(greatest(s * 0.4 + 0.3 / (1 + vl / 10000) + 0.3 / (1 + vs), 0.0), 1.0) AS consensus
  FROM (SELECT *, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS h FROM best) JOIN alike USING (page_id) JOIN spread USING (page_id)
), odds AS (
  SELECT *, {" + ".join(f"ln(least(greatest({c}, 0.01), 0.99) / (1 - least(greatest({c}, 0.01), 0.99))) * {w}" for c, w in scoring.BAYES_WEIGHTS.items())} AS z FROM parts2
)
SELECT page_id, round(extraction, 6) AS extraction, round(quality, 6) AS quality, round(metadata, 6) AS metadata,
  round(credibility, 6) AS credibility, round(consensus, 6) AS consensus, round(exp(z) / (1 + exp(z)), 6) AS overall FROM odds""",
    "stream_confidence": f"""WITH {SCORED_SQL}, c AS (
  SELECT page_id, method, least(greatest(CASE WHEN method = 'stripped' THEN 0.45 ELSE 0.62 END
    + CASE WHEN n > 1200 THEN 0.1 WHEN n < 400 THEN -0.08 ELSE 0.0 END + CASE WHEN paragraph_count > 5 THEN 0.05 ELSE 0.0 END, 0.2), 0.95) AS v,
    CASE {_WALL} ELSE 0 END AS walled FROM best)
SELECT page_id, method, round(CASE WHEN walled = 1 THEN least(v, 0.15) ELSE v END::DOUBLE, 9) AS confidence FROM c""",
    "page_nodes": rf"""WITH {NODE_SQL}
SELECT page_id, node_no, text, heading AS is_heading,
  round(least(greatest(0.62 + CASE WHEN heading THEN 0.02 WHEN length(text) > 200 THEN 0.04 WHEN length(text) < 40 THEN -0.08 ELSE 0.0 END, 0.1), 0.98)::DOUBLE, 9) AS confidence,
  sha256(url || ':' || node_no::VARCHAR || ':' || left(text, 64)) AS node_hash
FROM node WHERE length(text) > 0""",
    "gated_pages": f"""WITH b AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
r AS (SELECT kind, id, {_reason_sql(html.CHALLENGES)} AS challenge, {_reason_sql(html.WALLS)} AS wall FROM b)
SELECT *, challenge IS NOT NULL OR wall IS NOT NULL AS is_gated FROM r""",
    "page_types": f"""WITH x AS (SELECT page_id, lower(left(html, 10000)) AS html, lower({_TITLE}) AS title, lower(url) AS url FROM pages),
y AS (SELECT *, title || ' ' || url AS named, title || ' ' || html AS head FROM x),
s AS (SELECT page_id, {", ".join(f"({_signal_sql(t)})::DOUBLE AS s{k}" for k, t in enumerate(PAGE_TYPES))} FROM y),
g AS (SELECT *, greatest({", ".join(f"s{k}" for k in range(len(PAGE_TYPES)))}) AS m FROM s)
SELECT page_id, CASE WHEN m <= 0 THEN 'unknown' {" ".join(f"WHEN s{k} = m THEN '{t}'" for k, t in enumerate(PAGE_TYPES))} END AS page_type,
  round(least(greatest(m, 0.1), 0.95), 9) AS confidence FROM g""",
}
