"""Read queries over the stored tables.

Each query checks its parameters before building a plan (F9) and adds only the filters that were given (F7).
Limits are the feature here (top-k reads): ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject, i.e. a
per-task top-n and a final merge of n rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.dates import duration_ms, duration_seconds
from articleflow.functions.predicates import all_of, check_limit, given
from articleflow.schemas import (
    DEFAULT_ARTICLE_TYPE, ITEMS_LIMIT_DEFAULT, ITEMS_LIMIT_MAX, RUNS_LIMIT_DEFAULT, RUNS_LIMIT_MAX, TRACE_FILE,
    TRACES_LIMIT_DEFAULT, TRACES_LIMIT_MAX,
)

ITEM_COLUMNS = ["item_id", "title", "summary", "key_points", "topics", "article_type", "original_urls",
                "source_types", "published_at", "processed_at"]


def item_filter(topic: str | None = None, article_type: str | None = None,
                min_relevance: float | None = None) -> F.Column:
    """The optional filters of the item reads, ANDed; None or '' means no filter (F4, F5, F7, R2). They apply to
    the stored columns (before the read projection), so the type and score filters reach the Parquet scan; a
    missing type counts as the default 'news' (P21)."""
    type_pred = None
    if given(article_type):
        type_pred = F.col("article_type") == article_type
        if article_type == DEFAULT_ARTICLE_TYPE:
            type_pred = type_pred | F.col("article_type").isNull()
    return all_of([
        F.array_contains("topics", topic) if given(topic) else None,
        type_pred,
        (F.col("relevance_score") >= F.lit(float(min_relevance))) if min_relevance else None,
    ])


def select_items(news: DataFrame) -> DataFrame:
    """Fixed projection of the item reads, without embedding and housekeeping times (S5); a missing article
    type reads as 'news' (P21)."""
    cols = [F.coalesce(F.col(c), F.lit(DEFAULT_ARTICLE_TYPE)).alias(c) if c == "article_type" else F.col(c)
            for c in ITEM_COLUMNS]
    extra = [c for c in ("relevance_score",) if c in news.columns]
    return news.select(*cols, *extra)


def recent_items(news: DataFrame, limit: int = ITEMS_LIMIT_DEFAULT, topic: str | None = None,
                 article_type: str | None = None, min_relevance: float | None = None) -> DataFrame:
    """Newest items first, at most ``limit`` (1..100), optionally by topic / type / minimum score (L4)."""
    check_limit(limit, ITEMS_LIMIT_MAX)
    return (select_items(news.filter(item_filter(topic, article_type, min_relevance)))
            .orderBy(F.desc("published_at"), F.asc("item_id")).limit(limit))


def items_total(news: DataFrame, topic: str | None = None, article_type: str | None = None,
                min_relevance: float | None = None) -> DataFrame:
    """Number of matching items before the limit (the declared ``total``)."""
    return news.filter(item_filter(topic, article_type, min_relevance)).agg(F.count(F.lit(1)).alias("total"))


def get_item(news: DataFrame, item_id: str) -> DataFrame:
    """Point lookup; an empty result means not found."""
    return select_items(news).filter(F.col("item_id") == item_id)


def with_run_columns(runs: DataFrame) -> DataFrame:
    """Run rows with duration_seconds (null while running) and null counters as 0."""
    return runs.select(
        "run_id", "run_date", "started_at", "completed_at",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("items_collected", "items_processed", "items_persisted")],
        "status", "error_message",
        duration_seconds("started_at", "completed_at").alias("duration_seconds"),
    )


def recent_runs(runs: DataFrame, limit: int = RUNS_LIMIT_DEFAULT) -> DataFrame:
    """Latest runs by run_date, at most ``limit`` (1..100)."""
    check_limit(limit, RUNS_LIMIT_MAX)
    return with_run_columns(runs).orderBy(F.desc("run_date"), F.asc("run_id")).limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    return recent_runs(runs, 1)


def run_outcome(runs: DataFrame) -> DataFrame:
    """Outcome columns of a run trigger: status, items processed or the error text."""
    return runs.select("run_id", "status", F.coalesce(F.col("items_processed"), F.lit(0)).alias("items_processed"),
                       F.when(F.col("status") == "failed", F.col("error_message")).alias("error_message"))


def read_traces(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Trace export files with a fixed schema (S13): one pretty-printed document per file (``multi_line``), or
    JSON lines."""
    return spark.read.option("multiLine", multi_line).schema(TRACE_FILE).json(path)


def trace_runs(traces: DataFrame, project: str | None = None, limit: int = TRACES_LIMIT_DEFAULT) -> DataFrame:
    """Root traces of one project, newest first (F10, P19, P20, L6). Costs arrive as text → DECIMAL."""
    check_limit(limit, TRACES_LIMIT_MAX)
    m = F.col("metadata")
    start = F.to_timestamp(m["start_time"])
    end = F.to_timestamp(m["end_time"])
    cond = all_of([
        F.coalesce(m["custom_metadata"]["ls_run_depth"], F.lit(0)) == 0,
        (m["custom_metadata"]["LANGSMITH_PROJECT"] == project) if given(project) else None,
    ])
    return (traces.filter(cond).select(
        F.col("trace_id").alias("id"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unnamed")).alias("name"),
        F.coalesce(F.nullif(m["status"], F.lit("")), F.lit("unknown")).alias("status"),
        start.alias("start_time"), end.alias("end_time"),
        duration_ms(start, end).alias("duration_ms"),
        F.col("error"),
        m["token_usage"]["prompt_tokens"].alias("prompt_tokens"),
        m["token_usage"]["completion_tokens"].alias("completion_tokens"),
        m["token_usage"]["total_tokens"].alias("total_tokens"),
        m["costs"]["total_cost"].cast("decimal(18,6)").alias("total_cost"),
    ).orderBy(F.desc("start_time"), F.asc("id")).limit(limit))
