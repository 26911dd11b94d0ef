"""DuckDB SQL for every catalogue query: an independent statement of each result over the same tables.

The SQL is composed from shared CTEs (the table bindings, dedup, enrichment) so each query reads like the
SQL a user would write; column names match the Spark outputs exactly.
"""

from __future__ import annotations

TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"


def ts(expr: str) -> str:
    return f"strftime({expr}, {TS_FMT})"


# -- bindings ---------------------------------------------------------------------------------------------
RAW_PAGES = r"""
raw_pages AS (
  SELECT 'rss' AS source_type,
         coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), ''), url) AS source_id,
         nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n]+', ' ', 'g')), '') AS title,
         trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
                                            '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS content,
         CAST(NULL AS VARCHAR) AS author,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id) AS published_at,
         url,
         CAST(page_id AS BIGINT) AS seq,
         CAST(page_id AS VARCHAR) AS entry_id,
         CAST(NULL AS VARCHAR) AS lang
  FROM pages
)"""

RAW_DOCS = r"""
raw_docs AS (
  SELECT 'gmail' AS source_type, source AS source_id, CAST(NULL AS VARCHAR) AS title, text AS content,
         CAST(NULL AS VARCHAR) AS author,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published_at,
         CAST(NULL AS VARCHAR) AS url,
         CAST(doc_id AS BIGINT) AS seq,
         CAST(doc_id AS VARCHAR) AS entry_id,
         lang
  FROM documents
)"""

RAW = r"""
raw0 AS (SELECT * FROM raw_pages UNION ALL SELECT * FROM raw_docs),
raw AS (
  SELECT *,
         substr(sha256(CASE WHEN url IS NOT NULL AND url <> '' THEN url
                            ELSE coalesce(title, '') || substr(coalesce(content, ''), 1, 500) END), 1, 32) AS item_id
  FROM raw0
  WHERE content IS NOT NULL AND length(content) > 0
)"""

# Primary row by window, merged parts by plain aggregation; joined back.
DEDUP = r"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(content) DESC, seq ASC) AS rn FROM raw
),
grp AS (
  SELECT item_id, count(*) AS n, min(published_at) AS min_published, min(seq) AS min_seq,
         coalesce(list_sort(list_distinct(list(url) FILTER (WHERE url IS NOT NULL AND url <> ''))), []::VARCHAR[]) AS all_urls,
         list_sort(list_distinct(list(source_type))) AS merged_sources,
         list_sort(list_distinct(list(source_id))) AS merged_ids,
         list_sort(list_distinct(list(source_type || ':' || source_id))) AS metadata_keys
  FROM raw GROUP BY item_id
),
dedup AS (
  SELECT r.item_id, r.source_type, r.source_id, r.title, r.content, r.author,
         CASE WHEN g.n = 1 THEN r.published_at ELSE g.min_published END AS published_at,
         CASE WHEN g.n = 1 THEN r.url
              ELSE coalesce(CASE WHEN r.url IS NOT NULL AND r.url <> '' THEN r.url END, g.all_urls[1]) END AS url,
         g.min_seq AS seq, g.n AS n_merged,
         CASE WHEN g.n > 1 THEN g.merged_sources END AS merged_sources,
         CASE WHEN g.n > 1 THEN g.merged_ids END AS merged_ids,
         CASE WHEN g.n > 1 THEN g.all_urls END AS all_urls,
         CASE WHEN g.n > 1 THEN g.metadata_keys END AS metadata_keys,
         r.entry_id, r.lang
  FROM ranked r JOIN grp g USING (item_id) WHERE r.rn = 1
)"""


# Fixed values, written out here on their own: the topic vocabulary and the keyword rules.
TOPICS = ("['LLMs', 'AI Agents', 'AI Safety', 'MLOps', 'Computer Vision', 'NLP', 'Open Source', 'Products', 'Research', "
          "'Industry']")
HITS = """list_filter([
  CASE WHEN regexp_matches(low, 'llm|language model|gpt|transformer') THEN 'LLMs' END,
  CASE WHEN regexp_matches(low, 'agent') THEN 'AI Agents' END,
  CASE WHEN regexp_matches(low, 'safety|alignment|jailbreak') THEN 'AI Safety' END,
  CASE WHEN regexp_matches(low, 'mlops|deploy|pipeline|monitoring') THEN 'MLOps' END,
  CASE WHEN regexp_matches(low, 'vision|image|video|pixel') THEN 'Computer Vision' END,
  CASE WHEN regexp_matches(low, 'nlp|token|translation|sentiment') THEN 'NLP' END,
  CASE WHEN regexp_matches(low, 'open source|open-source|github|licen') THEN 'Open Source' END,
  CASE WHEN regexp_matches(low, 'launch|product|release|pricing') THEN 'Products' END,
  CASE WHEN regexp_matches(low, 'paper|research|study|benchmark|arxiv') THEN 'Research' END,
  CASE WHEN regexp_matches(low, 'company|market|funding|acquisition|startup') THEN 'Industry' END], lambda x: x IS NOT NULL)"""
TUTORIAL = "how to|tutorial|step by step|step-by-step|walkthrough|guide"


def enrich_ctes(src: str = "dedup") -> str:
    return rf"""
sents AS (
  SELECT d.*,
         list_filter(list_transform(regexp_extract_all(coalesce(content, ''), '[^.!?\n]+[.!?]*', 0),
                                    lambda s: trim(s)), lambda s: length(s) > 0) AS sents,
         lower(content) AS low
  FROM {src} d
),
hits AS (SELECT *, {HITS} AS hits FROM sents),
enriched AS (
  SELECT *,
         coalesce(nullif(trim(title), ''), sents[1]) AS e_title,
         nullif(array_to_string(sents[1:2], ' '), '') AS e_summary,
         list_transform(list_sort(list_transform(sents, lambda s, i: {{'k': -length(s), 'i': i, 's': s}})),
                        lambda x: x.s)[1:5] AS e_key_points,
         CASE WHEN len(hits) > 0 THEN hits[1:3]
              ELSE [({TOPICS})[(('0x' || substr(item_id, 1, 8))::BIGINT % 10) + 1]] END AS e_topics,
         CASE WHEN regexp_matches(low, '{TUTORIAL}') THEN 'tutorial' ELSE 'news' END AS e_article_type
  FROM hits
),
checked AS (
  SELECT *, coalesce(e_title IS NOT NULL AND e_summary IS NOT NULL AND e_article_type IS NOT NULL
                     AND e_key_points IS NOT NULL AND e_topics IS NOT NULL
                     AND len(e_key_points) BETWEEN 3 AND 5 AND len(e_topics) BETWEEN 1 AND 3, false) AS is_valid
  FROM enriched
)"""


def processed_cte(name: str = "processed", processed_at: str = "2024-03-01 00:00:00", only_valid: bool = True,
                  title: str = "e_title") -> str:
    where = "WHERE is_valid" if only_valid else ""
    return f"""
{name} AS (
  SELECT item_id, {title} AS title, e_summary AS summary, e_key_points AS key_points, e_topics AS topics,
         e_article_type AS article_type,
         CASE WHEN n_merged > 1 THEN all_urls
              ELSE CASE WHEN url IS NOT NULL AND url <> '' THEN [url] ELSE []::VARCHAR[] END END AS original_urls,
         CASE WHEN n_merged > 1 THEN merged_sources ELSE [source_type] END AS source_types,
         published_at, TIMESTAMP '{processed_at}' AS processed_at, seq
  FROM checked {where}
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


BASE = (RAW_PAGES, RAW_DOCS, RAW)
BASE_DEDUP = BASE + (DEDUP,)
BASE_ENRICH = BASE_DEDUP + (enrich_ctes(),)
BASE_PROCESSED = BASE_ENRICH + (processed_cte(),)


def iso(expr: str) -> str:
    return (f"CASE WHEN epoch_us({expr}) % 1000000 = 0 THEN strftime({expr}, '%Y-%m-%dT%H:%M:%S') || '+00:00' "
            f"ELSE strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END")


def sql_text(s: str) -> str:
    """A Python string as a SQL string expression (newlines via chr(10))."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits)


HOST_RX = "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"
ERR_STATUS = "CASE WHEN value >= 100 THEN 500 ELSE 404 END"
ERR_REASON = "CASE WHEN value >= 100 THEN 'Internal Server Error' ELSE 'Not Found' END"

RUNS = """
runs0 AS (
  SELECT date_trunc('hour', ts) AS run_date, min(ts) AS started_at, max(ts) AS completed_at,
         CAST(count(*) AS INTEGER) AS items_collected,
         CAST(count(*) FILTER (WHERE event_type <> 'error') AS INTEGER) AS items_processed,
         CAST(count(*) FILTER (WHERE event_type = 'purchase') AS INTEGER) AS items_persisted,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS INTEGER) AS collection_errors
  FROM events GROUP BY 1
),
runs AS (
  SELECT 'run_' || strftime(run_date, '%Y%m%d_%H%M%S') AS run_id, run_date, started_at, completed_at,
         items_collected, items_processed, items_persisted, collection_errors,
         CASE WHEN collection_errors * 2 > items_collected THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN collection_errors * 2 > items_collected THEN 'errors: ' || CAST(collection_errors AS VARCHAR) END
           AS error_message
  FROM runs0
)"""

ERRORS = f"""
errs AS (
  SELECT 'rss' AS source_type, 'feed' || CAST(user_id AS VARCHAR) AS source_id, 'HTTPStatusError' AS error_type,
         'HTTP ' || CAST({ERR_STATUS} AS VARCHAR) || ': ' || {ERR_REASON} AS error_message, ts AS timestamp
  FROM events WHERE event_type = 'error'
)"""

SCORED = """
scored AS (
  SELECT p.*, (l.quality + (1 - l.toxic)) / 2.0 AS relevance_score
  FROM processed p LEFT JOIN labels l ON p.seq = l.doc_id AND list_contains(p.source_types, 'gmail')
)"""


def item_out(src: str, where: str, limit: int, order: str = "published_at DESC, item_id ASC") -> str:
    return f"""
SELECT item_id, title, array_to_string(topics, ',') AS topics, coalesce(article_type, 'news') AS article_type,
       {ts('published_at')} AS published_at
FROM {src} WHERE {where} ORDER BY {order} LIMIT {limit}"""


Q: dict[str, str] = {}

Q["feed_dimension"] = f"""
SELECT DISTINCT source_type, name FROM (
  SELECT 'rss' AS source_type, coalesce(nullif(regexp_extract(url, '{HOST_RX}', 1), ''), url) AS name FROM pages
  UNION ALL
  SELECT 'gmail' AS source_type, source AS name FROM documents)"""

Q["feed_coverage"] = """
WITH senders AS (SELECT DISTINCT source AS name FROM documents),
win AS (SELECT source AS src FROM documents
        WHERE TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) >= TIMESTAMP '2024-02-05 00:00:00')
SELECT s.name, count(w.src) AS items FROM senders s LEFT JOIN win w ON s.name = w.src GROUP BY s.name"""

Q["item_id_url"] = """
SELECT page_id, substr(sha256(CASE WHEN url IS NOT NULL AND url <> '' THEN url ELSE '' END), 1, 32) AS item_id
FROM pages"""

Q["item_id_fallback"] = """
SELECT doc_id, substr(sha256('' || substr(coalesce(text, ''), 1, 500)), 1, 32) AS item_id FROM documents"""

Q["backfill_filter"] = with_ctes(*BASE) + f"""
SELECT item_id, source_type, seq, {ts('published_at')} AS published_at
FROM raw WHERE published_at >= TIMESTAMP '2024-01-13 00:00:00'"""

Q["date_coalesce"] = f"""
SELECT event_id, event_type,
       {ts("CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-03-01 00:00:00' ELSE date_trunc('second', ts) END")}
         AS published_at
FROM events"""

Q["content_longest"] = """
WITH c AS (
  SELECT doc_id, substr(text, 1, length(text) // 2) AS a, text AS b, substr(text, 1, 100) AS c FROM documents
), best AS (
  SELECT doc_id,
         CASE WHEN length(a) >= length(b) AND length(a) >= length(c) THEN a
              WHEN length(b) >= length(c) THEN b ELSE c END AS best
  FROM c
)
SELECT doc_id, CAST(length(best) AS BIGINT) AS content_len, sha256(best) AS content_sha FROM best"""

Q["collect_union"] = with_ctes(*BASE) + "SELECT item_id, source_type, source_id, seq FROM raw"

Q["collect_stats"] = with_ctes(*BASE, ERRORS) + """,
ic AS (SELECT source_type, source_id, count(*) AS items FROM raw GROUP BY ALL),
ec AS (SELECT source_type, source_id, count(*) AS errors FROM errs GROUP BY ALL)
SELECT coalesce(ic.source_type, ec.source_type) AS source_type, coalesce(ic.source_id, ec.source_id) AS source_id,
       coalesce(items, 0) AS items, coalesce(errors, 0) AS errors
FROM ic FULL OUTER JOIN ec ON ic.source_type = ec.source_type AND ic.source_id = ec.source_id"""

Q["raw_item_projection"] = with_ctes(*BASE) + """
SELECT item_id, seq, source_type, source_id AS feed_name, title AS feed_title, entry_id,
       coalesce(lang, '') AS tags
FROM raw"""

Q["error_rows"] = with_ctes(ERRORS) + "SELECT source_type, source_id, error_message AS error, error_type FROM errs"

Q["dedup_exact"] = with_ctes(*BASE_DEDUP) + f"""
SELECT item_id, source_type, source_id, title,
       CAST(length(content) AS BIGINT) AS content_len, sha256(content) AS content_sha,
       {ts('published_at')} AS published_at, url, seq, CAST(n_merged AS BIGINT) AS n_merged,
       array_to_string(merged_sources, ',') AS merged_sources,
       array_to_string(merged_ids, ',') AS merged_ids,
       array_to_string(all_urls, ',') AS all_urls,
       array_to_string(metadata_keys, ',') AS metadata_keys
FROM dedup"""

Q["dedup_stats"] = with_ctes(*BASE) + """
SELECT count(*) AS input_count, count(DISTINCT item_id) AS output_count,
       count(*) - count(DISTINCT item_id) AS duplicates_merged,
       CASE WHEN count(*) > 0 THEN round((1 - count(DISTINCT item_id) / count(*)) * 100, 1) ELSE 0.0 END
         AS reduction_pct
FROM raw"""

Q["dedup_primary_window"] = with_ctes(*BASE_DEDUP) + """
SELECT item_id, seq AS primary_seq, CAST(length(content) AS BIGINT) AS content_len FROM ranked WHERE rn = 1"""

Q["dedup_metadata_map"] = with_ctes(*BASE) + """,
multi AS (SELECT item_id FROM raw GROUP BY item_id HAVING count(*) > 1)
SELECT item_id, source_type || ':' || source_id AS source_key, arg_max(source_id, seq) AS feed_name,
       arg_max(entry_id, seq) AS entry_id
FROM raw WHERE item_id IN (SELECT item_id FROM multi)
GROUP BY item_id, source_type || ':' || source_id"""

Q["recent_sorted"] = with_ctes(*BASE_DEDUP) + f"""
SELECT item_id, row_number() OVER (ORDER BY published_at DESC, seq ASC, item_id ASC) AS recency_rank,
       {ts('published_at')} AS published_at
FROM dedup"""

Q["enrich_extractive"] = with_ctes(*BASE_ENRICH) + """
SELECT item_id, e_title AS title, e_summary AS summary, array_to_string(e_key_points, ' || ') AS key_points,
       array_to_string(e_topics, ',') AS topics, e_article_type AS article_type
FROM checked"""

Q["enrich_validity"] = with_ctes(*BASE_ENRICH) + """
SELECT item_id, CAST(is_valid AS INTEGER) AS is_valid, CAST(len(e_key_points) AS BIGINT) AS n_key_points,
       CAST(len(e_topics) AS BIGINT) AS n_topics
FROM checked"""

Q["enrich_quarantine"] = with_ctes(*BASE_ENRICH) + """
SELECT item_id, 'invalid_output' AS reason, CAST(len(e_key_points) AS BIGINT) AS n_key_points
FROM checked WHERE NOT is_valid"""

Q["enrich_counts"] = with_ctes(*BASE_ENRICH) + """
SELECT count(*) AS input_count, count(*) FILTER (WHERE is_valid) AS output_count,
       count(*) FILTER (WHERE NOT is_valid) AS failed_count
FROM checked"""

Q["processed_projection"] = with_ctes(*BASE_PROCESSED) + f"""
SELECT item_id, array_to_string(original_urls, ',') AS original_urls, array_to_string(source_types, ',') AS source_types,
       {ts('published_at')} AS published_at, {ts('processed_at')} AS processed_at
FROM processed"""


PROMPT = f"""'[' || coalesce({iso('published_at')}, '') || '] ' || coalesce(source_type, '') || '/' || coalesce(source_id, '')
  || ' sent: ' || coalesce(nullif(title, ''), 'No title') || chr(10) || '----' || chr(10) || substr(content, 1, 8000)
  || chr(10) || '----' || chr(10)
  || 'Answer with a headline, two sentences, three to five takeaways, up to three topics and a kind.'"""

Q["prompt_text"] = with_ctes(*BASE_DEDUP) + f""",
pr AS (SELECT item_id, {PROMPT} AS prompt FROM dedup)
SELECT item_id, CAST(length(prompt) AS BIGINT) AS prompt_len, sha256(prompt) AS prompt_sha FROM pr"""

Q["embedding_text"] = with_ctes(*BASE_PROCESSED) + """,
t AS (SELECT item_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(summary, '') AS txt FROM processed)
SELECT item_id, CAST(length(txt) AS BIGINT) AS text_len, sha256(txt) AS text_sha FROM t"""

Q["topic_distribution"] = with_ctes(*BASE_PROCESSED) + f""",
vocab AS (SELECT unnest({TOPICS}) AS topic),
counts AS (SELECT t AS topic, count(*) AS n FROM (SELECT unnest(topics) AS t FROM processed) GROUP BY t)
SELECT coalesce(v.topic, c.topic) AS topic, coalesce(c.n, 0) AS n FROM vocab v FULL OUTER JOIN counts c ON v.topic = c.topic"""

Q["source_distribution"] = with_ctes(*BASE_PROCESSED) + """
SELECT s AS source, count(*) AS n FROM (SELECT unnest(source_types) AS s FROM processed) GROUP BY s"""

Q["type_distribution"] = with_ctes(*BASE_PROCESSED) + """,
vocab AS (SELECT unnest(['news', 'tutorial']) AS article_type),
counts AS (SELECT coalesce(article_type, 'unknown') AS article_type, count(*) AS n FROM processed GROUP BY 1)
SELECT coalesce(v.article_type, c.article_type) AS article_type, coalesce(c.n, 0) AS n
FROM vocab v FULL OUTER JOIN counts c ON v.article_type = c.article_type"""

Q["run_stats_long"] = with_ctes(*BASE_PROCESSED, ERRORS) + """
SELECT 'total_items' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM processed
UNION ALL SELECT 'persisted_count', NULL, count(*) FROM processed
UNION ALL SELECT 'collection_errors', NULL, count(*) FROM errs
UNION ALL SELECT 'topic', t, count(*) FROM (SELECT unnest(topics) AS t FROM processed) GROUP BY t
UNION ALL SELECT 'source', s, count(*) FROM (SELECT unnest(source_types) AS s FROM processed) GROUP BY s
UNION ALL SELECT 'article_type', coalesce(article_type, 'unknown'), count(*) FROM processed GROUP BY 2"""

Q["by_topic_rank"] = with_ctes(*BASE_PROCESSED) + """
SELECT item_id, coalesce(topics[1], 'Uncategorized') AS primary_topic,
       row_number() OVER (PARTITION BY coalesce(topics[1], 'Uncategorized')
                          ORDER BY published_at DESC, seq ASC, item_id ASC) AS topic_rank
FROM processed"""

Q["payload_counts"] = with_ctes(*BASE_PROCESSED, ERRORS) + """
SELECT (SELECT count(*) FROM processed) AS item_count,
       (SELECT count(DISTINCT coalesce(topics[1], 'Uncategorized')) FROM processed) AS topic_count,
       (SELECT count(*) FROM errs) AS error_count"""

Q["run_meta"] = with_ctes(*BASE_PROCESSED) + """
SELECT 'run_20240108_000000_catalog' AS run_id, '2024-01-08T00:00:00+00:00' AS run_date,
       '2024-03-01T00:00:00+00:00' AS generated_at, '1.0' AS version, count(*) AS item_count
FROM processed"""

Q["api_items"] = with_ctes(*BASE_PROCESSED) + f"""
SELECT item_id AS id, title, array_to_string(original_urls, ',') AS urls, array_to_string(source_types, ',') AS sources,
       {iso('published_at')} AS published_at, {iso('processed_at')} AS processed_at,
       CAST(len(key_points) AS BIGINT) AS n_key_points
FROM processed"""

Q["iso_timestamps"] = f"SELECT event_id, {iso('ts')} AS iso FROM events"

UPSERT = with_ctes(*BASE_ENRICH, processed_cte("processed1"), processed_cte("processed2", "2024-03-02 00:00:00")) + """,
stored AS (
  SELECT p.* FROM processed1 p LEFT JOIN (SELECT doc_id AS seq, lang FROM documents) d USING (seq)
  WHERE NOT list_contains(p.source_types, 'gmail') OR d.lang IN ('en', 'fr')
),
incoming AS (SELECT * FROM processed2 WHERE list_contains(source_types, 'gmail')),
merged AS (
  SELECT coalesce(s.item_id, i.item_id) AS item_id,
         CASE WHEN s.item_id IS NOT NULL AND i.item_id IS NOT NULL THEN 'updated'
              WHEN i.item_id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS change,
         CASE WHEN s.item_id IS NOT NULL THEN s.published_at ELSE i.published_at END AS published_at,
         CASE WHEN i.item_id IS NOT NULL THEN i.processed_at ELSE s.processed_at END AS processed_at,
         CASE WHEN s.item_id IS NOT NULL THEN s.processed_at ELSE TIMESTAMP '2024-03-02 00:00:00' END AS created_at,
         CASE WHEN i.item_id IS NOT NULL THEN TIMESTAMP '2024-03-02 00:00:00' ELSE s.processed_at END AS updated_at,
         CASE WHEN i.item_id IS NOT NULL THEN i.title ELSE s.title END AS title
  FROM stored s FULL OUTER JOIN incoming i ON s.item_id = i.item_id
)"""

Q["upsert_merge"] = UPSERT + f"""
SELECT item_id, change, {ts('published_at')} AS published_at, {ts('processed_at')} AS processed_at,
       {ts('created_at')} AS created_at, {ts('updated_at')} AS updated_at, title
FROM merged"""

Q["upsert_columns_kept"] = UPSERT + f"""
SELECT item_id, {ts('published_at')} AS published_at, {ts('created_at')} AS created_at,
       {ts('updated_at')} AS updated_at, {ts('processed_at')} AS processed_at
FROM merged WHERE change = 'updated'"""

Q["upsert_counts"] = UPSERT + """
SELECT count(*) FILTER (WHERE change <> 'kept') AS persisted, count(*) FILTER (WHERE change = 'inserted') AS inserted,
       count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'kept') AS kept,
       count(*) AS total
FROM merged"""

Q["reject_rows"] = with_ctes(*BASE_ENRICH, processed_cte("candidates", only_valid=False, title="title")) + """
SELECT item_id,
       CASE WHEN item_id IS NULL OR length(item_id) > 64 THEN 'item_id'
            WHEN title IS NULL THEN 'title' WHEN summary IS NULL THEN 'summary'
            WHEN key_points IS NULL THEN 'key_points' WHEN topics IS NULL THEN 'topics'
            WHEN article_type IS NULL OR length(article_type) > 20 THEN 'article_type'
            WHEN original_urls IS NULL THEN 'original_urls' WHEN source_types IS NULL THEN 'source_types'
            WHEN published_at IS NULL THEN 'published_at' WHEN processed_at IS NULL THEN 'processed_at' END
         AS reject_reason
FROM candidates
WHERE item_id IS NULL OR length(item_id) > 64 OR title IS NULL OR summary IS NULL OR key_points IS NULL
   OR topics IS NULL OR article_type IS NULL OR length(article_type) > 20 OR original_urls IS NULL
   OR source_types IS NULL OR published_at IS NULL OR processed_at IS NULL"""

Q["json_columns"] = with_ctes(*BASE_PROCESSED) + """
SELECT item_id, CAST(to_json(key_points) AS VARCHAR) AS key_points_json, CAST(to_json(topics) AS VARCHAR) AS topics_json,
       CAST(to_json(original_urls) AS VARCHAR) AS original_urls_json,
       CAST(to_json(source_types) AS VARCHAR) AS source_types_json
FROM processed"""

Q["table_counts"] = with_ctes(*BASE_PROCESSED, RUNS) + """
SELECT 'news_items' AS table_name, count(*) AS row_count FROM processed
UNION ALL SELECT 'pipeline_runs', count(*) FROM runs
UNION ALL SELECT 'raw_items', count(*) FROM raw"""

RESTARTED = "run_20240130_230000"
Q["run_log_upsert"] = with_ctes(RUNS) + f""",
log AS (
  SELECT run_id, run_date,
         CASE WHEN run_id = '{RESTARTED}' THEN TIMESTAMP '2024-03-01 00:00:00' ELSE started_at END AS started_at,
         CASE WHEN run_id = '{RESTARTED}' THEN TIMESTAMP '2024-03-02 00:00:00' ELSE completed_at END AS completed_at,
         items_collected, items_processed,
         CASE WHEN run_id = '{RESTARTED}' THEN 0 ELSE items_persisted END AS items_persisted,
         collection_errors,
         CASE WHEN run_id = '{RESTARTED}' THEN 'failed' ELSE status END AS status,
         CASE WHEN run_id = '{RESTARTED}' THEN 'provider unavailable' ELSE error_message END AS error_message
  FROM runs
  UNION ALL
  SELECT 'run_catalog', TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-03-01 00:00:00',
         TIMESTAMP '2024-03-02 00:00:00', 9, 8, 7, 1, 'completed', NULL
)
SELECT run_id, {ts('run_date')} AS run_date, {ts('started_at')} AS started_at, {ts('completed_at')} AS completed_at,
       CAST(items_collected AS INTEGER) AS items_collected, CAST(items_processed AS INTEGER) AS items_processed,
       CAST(items_persisted AS INTEGER) AS items_persisted, CAST(collection_errors AS INTEGER) AS collection_errors,
       status, error_message
FROM log"""

DURATION = "round((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0, 6)"
Q["run_history"] = with_ctes(RUNS) + f"""
SELECT run_id, {ts('run_date')} AS run_date, coalesce(items_collected, 0) AS items_collected,
       coalesce(items_processed, 0) AS items_processed, coalesce(items_persisted, 0) AS items_persisted,
       status, error_message, {DURATION} AS duration_seconds
FROM runs ORDER BY run_date DESC, run_id ASC LIMIT 20"""

Q["latest_run"] = with_ctes(RUNS) + f"""
SELECT run_id, status, {DURATION} AS duration_seconds FROM runs ORDER BY run_date DESC, run_id ASC LIMIT 1"""

Q["run_outcome"] = with_ctes(RUNS) + """
SELECT run_id, status, coalesce(items_processed, 0) AS items_processed,
       CASE WHEN status = 'failed' THEN error_message END AS error_message
FROM runs"""

Q["items_by_topic"] = with_ctes(*BASE_PROCESSED) + item_out("processed", "list_contains(topics, 'Research')", 20)
Q["items_by_type"] = with_ctes(*BASE_PROCESSED) + item_out("processed", "article_type = 'news'", 20)
Q["items_filtered_topk"] = with_ctes(*BASE_PROCESSED) + item_out(
    "processed", "list_contains(topics, 'LLMs') AND article_type = 'news'", 100)
Q["items_total"] = with_ctes(*BASE_PROCESSED) + """
SELECT count(*) AS total FROM processed WHERE list_contains(topics, 'Research')"""
Q["item_by_id"] = with_ctes(*BASE_PROCESSED) + item_out(
    "processed", "item_id = (SELECT substr(sha256(url), 1, 32) FROM pages ORDER BY page_id LIMIT 1)", 1000000000)
Q["items_top5"] = with_ctes(*BASE_PROCESSED) + item_out("processed", "true", 5, "published_at DESC, seq ASC")

Q["age_buckets"] = with_ctes(*BASE_PROCESSED) + """,
m AS (SELECT CAST(floor((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(published_at)) / 60000000.0) AS BIGINT)
        AS minutes FROM processed),
b AS (SELECT CASE WHEN minutes < 60 THEN 'minutes' WHEN minutes < 1440 THEN 'hours'
                  WHEN minutes < 10080 THEN 'days' ELSE 'older' END AS bucket,
             CASE WHEN minutes < 60 THEN minutes WHEN minutes < 1440 THEN CAST(floor(minutes / 60) AS BIGINT)
                  ELSE CAST(floor(minutes / 1440) AS BIGINT) END AS n
      FROM m)
SELECT bucket, n, count(*) AS items FROM b GROUP BY bucket, n"""

Q["item_card_columns"] = with_ctes(*BASE_PROCESSED) + """
SELECT item_id AS id, original_urls[1] AS primary_url, array_to_string(key_points[1:3], ' || ') AS first_points,
       CAST(greatest(len(original_urls) - 1, 0) AS BIGINT) AS further_sources
FROM processed"""

Q["source_labels"] = with_ctes(*BASE_PROCESSED) + """
SELECT item_id,
       array_to_string(list_transform(source_types, lambda s: CASE s WHEN 'rss' THEN 'RSS'
                                                               WHEN 'gmail' THEN 'Newsletter' ELSE s END), ',')
         AS source_labels
FROM processed"""

Q["trace_durations"] = """
WITH t AS (SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, arg_min(event_type, ts) AS name
           FROM events GROUP BY user_id)
SELECT user_id, (epoch_us(end_time) - epoch_us(start_time)) // 1000 AS duration_ms,
       coalesce(nullif(CASE WHEN name = 'error' THEN '' ELSE name END, ''), 'Unnamed') AS name
FROM t"""

Q["relevance_filter"] = with_ctes(*BASE_PROCESSED, SCORED) + """
SELECT item_id, round(relevance_score, 6) AS relevance_score FROM scored WHERE relevance_score >= 0.7"""

Q["relevance_breakdown"] = with_ctes(*BASE_PROCESSED, SCORED) + """
SELECT count(*) FILTER (WHERE relevance_score >= 0.7) AS high,
       count(*) FILTER (WHERE relevance_score >= 0.4 AND relevance_score < 0.7) AS medium,
       count(*) FILTER (WHERE relevance_score < 0.4) AS low
FROM scored"""

Q["relevance_rank"] = with_ctes(*BASE_PROCESSED, SCORED) + """
SELECT item_id, coalesce(topics[1], 'Uncategorized') AS primary_topic,
       row_number() OVER (PARTITION BY coalesce(topics[1], 'Uncategorized')
                          ORDER BY relevance_score DESC NULLS LAST, published_at DESC, seq ASC, item_id ASC) AS topic_rank
FROM scored"""


Q["vector_topk"] = """
WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT q FROM q) AS DOUBLE[])), 6)
         AS similarity
FROM embeddings ORDER BY similarity DESC, vec_id ASC LIMIT 10"""

Q["vector_topk_many"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(c, 6) AS similarity FROM r WHERE rank <= 10"""

DOC_ITEMS = with_ctes(*BASE) + """,
doc_items AS (SELECT * FROM raw WHERE source_type = 'gmail')"""

Q["stream_ingest"] = DOC_ITEMS + "SELECT item_id, seq, source_id FROM doc_items"
Q["stream_dedup"] = DOC_ITEMS + "SELECT DISTINCT item_id FROM doc_items"
Q["stream_dedup_merged"] = Q["dedup_exact"] + " WHERE source_type = 'gmail'"
Q["stream_upsert"] = with_ctes(*BASE_PROCESSED) + item_out(
    "processed", "list_contains(source_types, 'gmail')", 1000000000)
Q["stream_daily_counts"] = with_ctes(*BASE, "doc_items AS (SELECT *, 1 AS n_merged FROM raw WHERE source_type = 'gmail')",
                                     enrich_ctes("doc_items")) + f"""
SELECT {ts("date_trunc('day', published_at)")} AS day, t AS topic, count(*) AS n
FROM (SELECT published_at, unnest(e_topics) AS t FROM checked) GROUP BY 1, 2"""

Q["stream_daily_final"] = """
WITH m AS (SELECT max(doc_id) + 1 AS n FROM documents),
d AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published, source, doc_id % 10 = 0 AND doc_id < n // 3 AS late FROM documents, m)
SELECT """ + ts("date_trunc('day', published)") + """ AS day, source AS topic, count(*) AS n, (SELECT count(*) FROM d WHERE late) AS late_rows
FROM d WHERE NOT late GROUP BY 1, 2"""

Q["feed_parse"] = """
WITH d AS (
  SELECT *, 'https://letters.example/' || source || '/' || CAST(doc_id AS VARCHAR) AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published
  FROM documents
)
SELECT substr(sha256(url), 1, 32) AS item_id, url, 'Note ' || CAST(doc_id AS VARCHAR) AS title,
       'doc-' || CAST(doc_id AS VARCHAR) AS entry_id, source AS feed_title, lang AS tags,
       CAST(length(text) AS BIGINT) AS content_len, sha256(text) AS content_sha,
       """ + ts("published") + """ AS published_at
FROM d WHERE published >= TIMESTAMP '2024-01-01 00:00:00' AND length(text) > 0"""

Q["feed_errors"] = with_ctes(ERRORS) + "SELECT source_type, source_id, error_type, error_message AS error FROM errs"

Q["enrich_batch_provider"] = Q["enrich_extractive"]

Q["trace_runs"] = """
WITH t AS (SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, arg_min(event_type, ts) AS name,
                  count(*) AS total_tokens
           FROM events GROUP BY user_id)
SELECT 'trace-' || CAST(user_id AS VARCHAR) AS id, coalesce(nullif(name, ''), 'Unnamed') AS name, 'success' AS status,
       (epoch_us(end_time) - epoch_us(start_time)) // 1000 AS duration_ms, total_tokens
FROM t ORDER BY start_time DESC, id ASC LIMIT 50"""

Q["full_run"] = with_ctes(*BASE_PROCESSED) + item_out("processed", "true", 1000000000)


PAIRS = """
pairs AS (
  SELECT a.vec_id AS id_a, b.vec_id AS id_b,
         list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4
)"""

COMPONENTS = """
e AS (SELECT id_a AS u, id_b AS v FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach(id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.id, e.v FROM reach JOIN e ON reach.r = e.u
),
comp AS (SELECT id AS vec_id, min(r) AS component FROM reach GROUP BY id)"""

Q["vector_pairs"] = "WITH " + PAIRS.strip() + "\nSELECT id_a, id_b, round(similarity, 6) AS similarity FROM pairs"
Q["vector_components"] = "WITH RECURSIVE " + PAIRS.strip() + ",\n" + COMPONENTS.strip() + "\nSELECT vec_id, component FROM comp"
Q["vector_group_merge"] = "WITH RECURSIVE " + PAIRS.strip() + ",\n" + COMPONENTS.strip() + """
SELECT c.component, count(*) AS n_members, min(c.vec_id) AS first_member, max(c.vec_id) AS last_member,
       min(m.label) AS min_label, max(m.label) AS max_label, count(DISTINCT m.label) AS n_labels
FROM comp c JOIN embeddings m ON c.vec_id = m.vec_id
GROUP BY c.component"""

PLANTED = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT * FROM e UNION ALL SELECT vec_id + 10000000, v FROM e WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id + 20000000, list_transform(v, lambda x, i: x + 0.02::DOUBLE * ((i - 1) % 3 - 1)) FROM e WHERE vec_id % 7 = 0)"""
Q["vector_components_planted"] = "WITH RECURSIVE " + PLANTED.strip() + """,
pairs AS (SELECT a.vec_id AS u, b.vec_id AS w FROM p a JOIN p b
          ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.85),
reach(id, r) AS (SELECT vec_id, vec_id FROM p UNION SELECT reach.id, pairs.w FROM reach JOIN pairs ON reach.r = pairs.u)
SELECT id AS vec_id, min(r) AS component FROM reach GROUP BY id"""
Q["vector_pairs_planted"] = "WITH " + PLANTED.strip() + """
SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.85"""

Q["vector_pairs_hashed"] = "WITH " + PLANTED.strip() + """,
one AS (SELECT min(vec_id) AS vec_id, v FROM p GROUP BY v)
SELECT count(*) AS exact_pairs, true AS recall_reached, 0 AS wrong_pairs
FROM one a JOIN one b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.85"""

Q["vector_ivf_full"] = Q["vector_topk"]

Q["semantic_dedup"] = with_ctes(*BASE_DEDUP).replace("WITH ", "WITH RECURSIVE ", 1) + """,
it AS (SELECT * FROM dedup WHERE source_type = 'gmail'),
iv AS (SELECT it.item_id, CAST(e.embedding AS DOUBLE[]) AS v FROM it JOIN embeddings e ON it.seq = e.vec_id),
ed AS (SELECT a.item_id AS u, b.item_id AS w FROM iv a JOIN iv b ON a.item_id <> b.item_id AND list_cosine_similarity(a.v, b.v) >= 0.4),
rc(id, r) AS (SELECT item_id, item_id FROM it UNION SELECT rc.id, ed.w FROM rc JOIN ed ON rc.r = ed.u),
cm AS (SELECT id AS item_id, min(r) AS component FROM rc GROUP BY id),
rk AS (SELECT it.*, component, row_number() OVER (PARTITION BY component ORDER BY length(content) DESC, it.seq ASC) AS rn
       FROM it JOIN cm USING (item_id)),
gr AS (SELECT component, count(*) AS n_merged, min(published_at) AS first, min(seq) AS min_seq FROM rk GROUP BY component)
SELECT rk.item_id, gr.n_merged, CAST(length(rk.content) AS BIGINT) AS content_len, """ + ts("gr.first") + """ AS published_at, gr.min_seq AS seq
FROM rk JOIN gr USING (component) WHERE rn = 1"""

Q["stream_upsert_updates"] = with_ctes(*BASE_PROCESSED) + """
SELECT item_id, '2024-03-01 00:00:00.000000' AS created_at, '2024-03-02 00:00:00.000000' AS updated_at
FROM processed WHERE list_contains(source_types, 'gmail')"""

Q["feed_parse_dialects"] = """
WITH d AS (
  SELECT source, doc_id % 4 AS kind, CAST(doc_id AS VARCHAR) AS n, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published,
         'https://d.example/' || CAST(doc_id AS VARCHAR) AS url, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean
  FROM documents)
SELECT substr(sha256(url), 1, 32) AS item_id, url,
       CASE kind WHEN 0 THEN 'Upper ' WHEN 1 THEN 'Atom ' WHEN 2 THEN 'Old ' ELSE 'Été × → ¥ 😀 😀 ' END || n AS title,
       CASE kind WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo & Co' WHEN 2 THEN 'Cy' ELSE 'Di' END AS author, source AS feed_title,
       CASE WHEN kind >= 2 THEN url END AS entry_id,
       sha256(CASE WHEN kind = 1 THEN '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'
                   WHEN kind = 2 AND length(clean) < 5 THEN 'short' ELSE clean END) AS content_sha,
       """ + ts("published") + """ AS published_at
FROM d WHERE published >= TIMESTAMP '2024-01-01 00:00:00' AND (kind IN (1, 2) OR length(clean) > 0)"""

Q["feed_parse_messy"] = """
WITH d AS (
  SELECT doc_id, source, text, doc_id % 5 AS kind, CAST(doc_id AS VARCHAR) AS n,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published FROM documents),
x AS (
  SELECT *, 'https://m.example/' || n || '?a=1&b=2' AS url,
         CASE kind WHEN 0 THEN 'Café' || chr(160) || n || ' – x' WHEN 1 THEN 'R & D ' || n WHEN 2 THEN 'Note ' || n
                   WHEN 3 THEN 'Open ' || n ELSE 'Atom ' || n END AS title,
         CASE kind WHEN 1 THEN '</item> <b>' || text WHEN 2 THEN 'one<br>two ' || text ELSE text END AS content
  FROM d)
SELECT substr(sha256(url), 1, 32) AS item_id, url, title, CASE WHEN kind = 4 THEN source ELSE source || ' & co' END AS feed_title,
       CAST(length(content) AS BIGINT) AS content_len, sha256(content) AS content_sha, """ + ts("published") + """ AS published_at
FROM x WHERE length(text) > 0"""

Q["landed_documents"] = """
SELECT substr(sha256('https://letters.example/' || source || '/' || CAST(doc_id AS VARCHAR)), 1, 32) AS item_id,
       'Note ' || CAST(doc_id AS VARCHAR) AS title, 'doc-' || CAST(doc_id AS VARCHAR) AS entry_id, CAST(length(text) AS BIGINT) AS content_len
FROM documents WHERE length(text) > 0"""

Q["feed_errors_all"] = """
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS n, event_id % 7 AS kind FROM events)
SELECT 'rss' AS source_type, 'u' || n AS source_id,
       CASE kind WHEN 0 THEN 'HTTPStatusError' WHEN 1 THEN 'HTTPStatusError' WHEN 2 THEN 'ConnectTimeout' WHEN 3 THEN 'RequestError'
                 ELSE 'ParseError' END AS error_type,
       CASE kind WHEN 0 THEN 'HTTP 404: Not Found' WHEN 1 THEN 'HTTP unknown: ' WHEN 2 THEN 'timed out' WHEN 3 THEN 'no route'
                 WHEN 4 THEN 'the body is no feed' ELSE '1 incomplete entries' END AS error
FROM e WHERE kind <> 6"""

Q["dedup_landed_feeds"] = """
SELECT substr(sha256('https://letters.example/' || source || '/' || CAST(doc_id AS VARCHAR)), 1, 32) AS item_id, CAST(2 AS BIGINT) AS n_merged,
       'https://letters.example/' || source || '/feed,https://mirror.example/' || source || '/feed' AS merged_ids,
       CAST(length(text) AS BIGINT) AS content_len, 'https://letters.example/' || source || '/' || CAST(doc_id AS VARCHAR) AS url
FROM documents WHERE length(text) > 0"""

Q["enrich_retry"] = with_ctes(*BASE_ENRICH) + """
SELECT item_id,
       CAST(CASE WHEN item_id LIKE '00%' THEN 1 WHEN NOT is_valid OR item_id LIKE '1%' THEN 3 WHEN item_id LIKE '2%' THEN 2 ELSE 1 END AS BIGINT) AS attempts,
       CASE WHEN item_id LIKE '00%' THEN 'ValueError: no answer for ' || item_id WHEN NOT is_valid OR item_id LIKE '1%' THEN 'invalid_output' END
         AS enrich_error,
       CASE WHEN item_id LIKE '00%' THEN NULL ELSE CAST(len(e_key_points) AS BIGINT) END AS n_key_points
FROM checked"""

Q["payload_items"] = with_ctes(*BASE_PROCESSED) + """
SELECT item_id AS id, title, summary, array_to_string(key_points, ' || ') AS key_points, coalesce(topics[1], 'Uncategorized') AS primary_topic,
       row_number() OVER (PARTITION BY coalesce(topics[1], 'Uncategorized') ORDER BY published_at DESC, seq ASC, item_id ASC) AS topic_rank
FROM processed"""

Q["json_round_trip"] = with_ctes(*BASE_PROCESSED) + """
SELECT item_id, array_to_string(key_points, ' || ') AS key_points, array_to_string(topics, ',') AS topics,
       array_to_string(original_urls, ',') AS original_urls, array_to_string(source_types, ',') AS source_types
FROM processed"""

Q["relevance_sorted"] = with_ctes(*BASE_PROCESSED, SCORED) + """
SELECT item_id, round(relevance_score, 6) AS relevance_score FROM scored
ORDER BY scored.relevance_score DESC NULLS LAST, published_at DESC, item_id ASC LIMIT 50"""

Q["relevance_stored"] = with_ctes(*BASE_PROCESSED, SCORED) + item_out("scored", "relevance_score >= 0.7", 100)


# the hashing embedding of every processed item has the full dimension and unit length (every item has words)
Q["embed_hashing"] = with_ctes(*BASE_PROCESSED) + "SELECT item_id, CAST(1536 AS BIGINT) AS dim, CAST(1.0 AS DOUBLE) AS norm FROM processed"


def all_sql() -> dict[str, str]:
    return dict(Q)
