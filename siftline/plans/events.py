"""Queries on what a page's extraction sends out: the guarded choice, the event stream and its reading."""

from pyspark.sql import functions as F

from siftline.functions import html
from siftline.operators import assembly, extraction
from siftline.plans.extraction import NODE_SQL, SCORED_SQL, _reason_sql, table

MAX_NODES = 5


def _chosen(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    scored = extraction.score_candidates(extraction.candidates(pages))
    return assembly.complete(scored, extraction.paragraphs(pages.select("page_id", "html")).select("page_id", "texts"))


def completeness_guard(spark, sf_dir):
    return _chosen(spark, sf_dir)


def page_events(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return assembly.events(pages, _chosen(spark, sf_dir), extraction.nodes(pages), MAX_NODES)


def event_lines(spark, sf_dir):
    """The stream as lines of JSON, as they are written."""
    rows = page_events(spark, sf_dir)
    line = F.concat(F.lit('{"type":"'), "type", F.lit('","payload":'), "payload", F.lit("}"))
    return rows.select("page_id", "seq", line.alias("line"))


def stream_texts(spark, sf_dir):
    return assembly.markdown(page_events(spark, sf_dir))


QUERIES = {f.__name__: f for f in (completeness_guard, page_events, event_lines, stream_texts)}

_GUARD = f"""WITH {SCORED_SQL}, low AS (
  SELECT *, paragraph_count < {assembly.MIN_PARAGRAPHS} OR n < {assembly.MIN_LENGTH} OR words < {assembly.MIN_WORDS} AS low FROM best
), other AS (
  SELECT s.page_id, s.method, s.content, s.paragraph_count FROM scored s JOIN low USING (page_id)
  WHERE low.low AND s.no <> low.no AND (s.paragraph_count >= {assembly.MIN_PARAGRAPHS} OR s.n >= {assembly.MIN_LENGTH})
  QUALIFY row_number() OVER (PARTITION BY s.page_id ORDER BY s.paragraph_count DESC, s.n DESC, s.no) = 1
), fill AS (
  SELECT l.page_id, CASE WHEN l.low AND o.page_id IS NULL AND l.paragraph_count < {assembly.FILL_TO}
    THEN b.every[1:{assembly.FILL_TO} - l.paragraph_count] ELSE [] END AS f
  FROM low l JOIN base b USING (page_id) LEFT JOIN other o USING (page_id)
), chosen AS (
  SELECT l.page_id, coalesce(o.method, l.method) AS method,
    CASE WHEN len(f) > 0 THEN l.content || chr(10) || chr(10) || array_to_string(f, chr(10) || chr(10)) ELSE coalesce(o.content, l.content) END AS content,
    (coalesce(o.paragraph_count, l.paragraph_count) + len(f))::INTEGER AS paragraph_count,
    CASE WHEN o.page_id IS NOT NULL THEN 'other' WHEN len(f) > 0 THEN 'filled' ELSE 'kept' END AS action
  FROM low l JOIN fill USING (page_id) LEFT JOIN other o USING (page_id)
)"""
_NODES = rf"""{NODE_SQL}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_no) AS k, count(*) OVER (PARTITION BY page_id) AS n_all FROM node WHERE length(text) > 0
)"""
_EVENTS = f"""{_GUARD}, {_NODES}, walled AS (
  SELECT page_id, url, html, {_reason_sql(html.CHALLENGES)} AS challenge, {_reason_sql(html.WALLS)} AS wall FROM (SELECT *, html AS body FROM pages)
), head AS (
  SELECT w.*, c.method, c.method = 'stripped' AS fallback, length(c.content) AS n_chars, coalesce(n_all, 0)::INTEGER AS n,
    trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)', 1, 'i'), '\\s+', ' ', 'g')) AS title
  FROM walled w JOIN chosen c USING (page_id) LEFT JOIN (SELECT DISTINCT page_id, n_all FROM kept) USING (page_id)
), sure0 AS (
  SELECT *, least(greatest(CASE WHEN fallback THEN 0.45 ELSE 0.62 END + CASE WHEN n_chars > 1200 THEN 0.1 WHEN n_chars < 400 THEN -0.08 ELSE 0.0 END
    + CASE WHEN n > 5 THEN 0.05 ELSE 0.0 END, 0.2), 0.95)::DOUBLE AS s FROM head
), page AS (
  SELECT *, round(CASE WHEN wall IS NOT NULL THEN least(s, 0.15) ELSE s END::DOUBLE, 9) AS sure, least(n, {MAX_NODES})::INTEGER AS n_kept FROM sure0
), e AS (
  SELECT page_id, 0 AS a, 0 AS b, 'metadata' AS type, to_json(struct_pack(url := url, bytes := octet_length(encode(html)))) AS payload FROM page
  UNION ALL SELECT page_id, 1, 0, 'alert', to_json(struct_pack(kind := 'challenge_detected', reason := challenge)) FROM page WHERE challenge IS NOT NULL
  UNION ALL SELECT page_id, 2, 0, 'alert', to_json(struct_pack(kind := 'auth_wall_detected', reason := wall)) FROM page WHERE wall IS NOT NULL
  UNION ALL SELECT page_id, 3, 0, 'confidence', to_json(struct_pack(overall := sure, auth_wall := wall IS NOT NULL, fallback := fallback, nodes := n, length := n_chars)) FROM page
  UNION ALL SELECT page_id, 4, 0, 'extraction', to_json(struct_pack(method := method, fallback := fallback)) FROM page
  UNION ALL SELECT k.page_id, 5, k.k, 'node', to_json(struct_pack(hash := sha256(k.url || ':' || node_no::VARCHAR || ':' || left(text, 64)), "order" := node_no,
      kind := CASE WHEN heading THEN 'heading' ELSE 'paragraph' END, text := text, confidence := round(least(greatest(sure
        + CASE WHEN heading THEN 0.02 WHEN length(text) > 200 THEN 0.04 WHEN length(text) < 40 THEN -0.08 ELSE 0.0 END, 0.1), 0.98)::DOUBLE, 9)))
    FROM kept k JOIN page USING (page_id) WHERE k.k <= {MAX_NODES}
  UNION ALL SELECT page_id, 6, 0, 'provenance', to_json(struct_pack(extractor := method, checksum := sha256(html), nodes := n_kept)) FROM page
  UNION ALL SELECT page_id, 7, 0, 'done', to_json(struct_pack(nodes := n_kept, truncated := n > n_kept, title := title)) FROM page
), ev AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY a, b) - 1)::INTEGER AS seq, type, payload::VARCHAR AS payload FROM e
)"""
ORACLE_SQL = {
    "completeness_guard": f"{_GUARD} SELECT * FROM chosen",
    "page_events": f"{_EVENTS} SELECT * FROM ev",
    "event_lines": _EVENTS + """ SELECT page_id, seq, '{"type":"' || type || '","payload":' || payload || '}' AS line FROM ev""",
    "stream_texts": _EVENTS
    + """ SELECT page_id, max(CASE WHEN type = 'done' THEN payload::JSON ->> '$.title' END) AS title,
  coalesce(string_agg(CASE WHEN payload::JSON ->> '$.kind' = 'heading' THEN '# ' ELSE '' END || (payload::JSON ->> '$.text'), chr(10) || chr(10) ORDER BY seq)
    FILTER (type = 'node'), '') AS text FROM ev GROUP BY 1""",
}
