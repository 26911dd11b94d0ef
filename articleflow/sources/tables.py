"""Parquet table scans and the bindings that turn the shared test tables into article rows.

Bindings (identical in the oracle SQL):
* pages → rss items: source_id = url host, title = ``<title>`` text, content = visible html text,
  published_at = 2024-01-01 + page_id hours, seq = page_id.
* documents → newsletter items: source_id = source, no url, no title, content = text,
  published_at = 2024-01-01 + doc_id hours, seq = doc_id.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.dates import hours_after
from articleflow.functions.text import html_title, strip_html
from articleflow.session import compute_once, prepare

BINDING_BASE = datetime(2024, 1, 1, tzinfo=UTC)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one table; a column list is applied at once so the Parquet reader only reads those columns."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def url_host(url) -> F.Column:
    return F.nullif(F.regexp_extract(url, HOST, 1), F.lit(""))


def _metadata(feed_name, feed_title, entry_id, tags):
    null_arr = F.lit(None).cast("array<string>")
    return F.struct(
        feed_name.alias("feed_name"), feed_title.alias("feed_title"), entry_id.alias("entry_id"),
        tags.alias("tags"), null_arr.alias("merged_from_sources"), null_arr.alias("merged_from_ids"),
        null_arr.alias("all_urls"),
        F.lit(None).cast("map<string,struct<feed_name:string,feed_title:string,entry_id:string,tags:array<string>>>")
        .alias("source_metadata"),
    )


def pages_as_items(pages: DataFrame) -> DataFrame:
    """Web pages as raw rss items (before ids). Title and visible text are regex passes over the whole page;
    they are computed once (``compute_once``) so the later empty-content filter does not repeat them."""
    host = url_host(F.col("url"))
    parsed = compute_once(pages, [html_title(F.col("html")).alias("_title"), strip_html(F.col("html")).alias("_text")])
    return parsed.select(
        F.lit("rss").alias("source_type"),
        F.coalesce(host, F.col("url")).alias("source_id"),
        F.col("_title").alias("title"),
        F.col("_text").alias("content"),
        F.lit(None).cast("string").alias("author"),
        hours_after(BINDING_BASE, F.col("page_id")).alias("published_at"),
        F.col("url"),
        _metadata(F.coalesce(host, F.col("url")), F.col("_title"), F.col("page_id").cast("string"),
                  F.array().cast("array<string>")).alias("raw_metadata"),
        F.col("page_id").cast("long").alias("seq"),
    )


def documents_as_items(documents: DataFrame) -> DataFrame:
    """Documents as raw newsletter items (before ids)."""
    return documents.select(
        F.lit("gmail").alias("source_type"),
        F.col("source").alias("source_id"),
        F.lit(None).cast("string").alias("title"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("author"),
        hours_after(BINDING_BASE, F.col("doc_id")).alias("published_at"),
        F.lit(None).cast("string").alias("url"),
        _metadata(F.col("source"), F.lit(None).cast("string"), F.col("doc_id").cast("string"),
                  F.array(F.col("lang"))).alias("raw_metadata"),
        F.col("doc_id").cast("long").alias("seq"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from articleflow.operators.collect import with_item_id

    return with_item_id(pages_as_items(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])))


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from articleflow.operators.collect import with_item_id

    return with_item_id(documents_as_items(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source", "lang"])))
