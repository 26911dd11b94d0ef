"""Record schemas and vocabularies of the article tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results (vocabularies and defaults).
# Topic categories, in their natural order:
#   LLMs, AI Agents, AI Safety, MLOps, Computer Vision, NLP, Open Source, Products, Research, Industry
# Article types: news, tutorial
# Run statuses: running, completed, failed
# Defaults: primary topic when an item has none "Uncategorized"; article type on read "news",
#   in distributions "unknown"; run id when missing "unknown"; payload version "1.0";
#   trace name "Unnamed", trace status "unknown"; id hex length 32; content sent to the model 8000 chars;
#   key points 3..5; topics 1..3; retries on invalid output 2; concurrency 5; embedding size 1536;
#   similarity threshold 0.85; ivf lists 100; recent items/runs limit 20 (1..100); traces limit 10 (1..50);
#   backfill days 0..30.
# ---------------------------------------------------------------------------------------------
TOPIC_CATEGORIES = [
    "LLMs", "AI Agents", "AI Safety", "MLOps", "Computer Vision", "NLP", "Open Source", "Products", "Research",
    "Industry",
]
ARTICLE_TYPES = ["news", "tutorial"]
RUN_STATUSES = ["running", "completed", "failed"]
UNCATEGORIZED = "Uncategorized"
DEFAULT_ARTICLE_TYPE = "news"
UNKNOWN = "unknown"
PAYLOAD_VERSION = "1.0"
ID_HEX_CHARS = 32
PROMPT_CONTENT_CHARS = 8000
FALLBACK_ID_CONTENT_CHARS = 500
KEY_POINTS_MIN, KEY_POINTS_MAX = 3, 5
TOPICS_MIN, TOPICS_MAX = 1, 3
MAX_RETRIES = 2
MAX_CONCURRENT = 5
EMBEDDING_DIM = 1536
SIMILARITY_THRESHOLD = 0.85
IVF_LISTS = 100
ITEMS_LIMIT_DEFAULT, ITEMS_LIMIT_MAX = 20, 100
RUNS_LIMIT_DEFAULT, RUNS_LIMIT_MAX = 20, 100
TRACES_LIMIT_DEFAULT, TRACES_LIMIT_MAX = 10, 50
BACKFILL_MAX_DAYS = 30

STR = T.StringType()
TS = T.TimestampType()
ARR_STR = T.ArrayType(T.StringType())

ENTRY_METADATA = T.StructType([
    T.StructField("feed_name", STR),
    T.StructField("feed_title", STR),
    T.StructField("entry_id", STR),
    T.StructField("tags", ARR_STR),
])

RAW_METADATA = T.StructType([
    T.StructField("feed_name", STR),
    T.StructField("feed_title", STR),
    T.StructField("entry_id", STR),
    T.StructField("tags", ARR_STR),
    T.StructField("merged_from_sources", ARR_STR),
    T.StructField("merged_from_ids", ARR_STR),
    T.StructField("all_urls", ARR_STR),
    T.StructField("source_metadata", T.MapType(STR, ENTRY_METADATA)),
])

RAW_ITEMS = T.StructType([
    T.StructField("source_type", STR),
    T.StructField("source_id", STR),
    T.StructField("item_id", STR),
    T.StructField("title", STR),
    T.StructField("content", STR),
    T.StructField("author", STR),
    T.StructField("published_at", TS),
    T.StructField("url", STR),
    T.StructField("raw_metadata", RAW_METADATA),
    T.StructField("seq", T.LongType()),
])

ENRICHMENT = T.StructType([
    T.StructField("title", STR),
    T.StructField("summary", STR),
    T.StructField("key_points", ARR_STR),
    T.StructField("topics", ARR_STR),
    T.StructField("article_type", STR),
])

PROCESSED_ITEMS = T.StructType([
    T.StructField("item_id", STR),
    T.StructField("title", STR),
    T.StructField("summary", STR),
    T.StructField("key_points", ARR_STR),
    T.StructField("topics", ARR_STR),
    T.StructField("article_type", STR),
    T.StructField("original_urls", ARR_STR),
    T.StructField("source_types", ARR_STR),
    T.StructField("published_at", TS),
    T.StructField("processed_at", TS),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

NEWS_ITEMS = T.StructType(PROCESSED_ITEMS.fields + [
    T.StructField("created_at", TS),
    T.StructField("updated_at", TS),
    T.StructField("relevance_score", T.DoubleType()),
])

PIPELINE_RUNS = T.StructType([
    T.StructField("run_id", STR),
    T.StructField("run_date", TS),
    T.StructField("started_at", TS),
    T.StructField("completed_at", TS),
    T.StructField("items_collected", T.IntegerType()),
    T.StructField("items_processed", T.IntegerType()),
    T.StructField("items_persisted", T.IntegerType()),
    T.StructField("collection_errors", T.IntegerType()),
    T.StructField("status", STR),
    T.StructField("error_message", STR),
])

COLLECTION_ERRORS = T.StructType([
    T.StructField("source_type", STR),
    T.StructField("source_id", STR),
    T.StructField("error_type", STR),
    T.StructField("error_message", STR),
    T.StructField("timestamp", TS),
])

FEED_DOCUMENTS = T.StructType([
    T.StructField("feed_name", STR),
    T.StructField("feed_url", STR),
    T.StructField("status", T.IntegerType()),
    T.StructField("reason", STR),
    T.StructField("body", STR),
    T.StructField("fetch_error", STR),
    T.StructField("seq", T.LongType()),
])

TRACE_FILE = T.StructType([
    T.StructField("trace_id", STR),
    T.StructField("name", STR),
    T.StructField("error", STR),
    T.StructField("metadata", T.StructType([
        T.StructField("status", STR),
        T.StructField("start_time", STR),
        T.StructField("end_time", STR),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("custom_metadata", T.StructType([
            T.StructField("LANGSMITH_PROJECT", STR),
            T.StructField("ls_run_depth", T.LongType()),
            T.StructField("revision_id", STR),
        ])),
        T.StructField("token_usage", T.StructType([
            T.StructField("prompt_tokens", T.LongType()),
            T.StructField("completion_tokens", T.LongType()),
            T.StructField("total_tokens", T.LongType()),
        ])),
        T.StructField("costs", T.StructType([
            T.StructField("prompt_cost", STR),
            T.StructField("completion_cost", STR),
            T.StructField("total_cost", STR),
        ])),
    ])),
])


def ddl(schema: T.StructType) -> str:
    """Schema as a DDL column list (for CREATE TABLE and from_json)."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
