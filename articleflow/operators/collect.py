"""Collection operators: ids, backfill window, empty-content drop, collector union, feed coverage
(P1, F1, F2, U1–U3, J3, A19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.context import RunContext
from articleflow.functions.ids import item_id
from articleflow.schemas import RAW_ITEMS

RAW_COLUMNS = [f.name for f in RAW_ITEMS.fields]


def with_item_id(df: DataFrame) -> DataFrame:
    """Adds ``item_id`` from url / title / content and orders the columns as a raw item."""
    return df.withColumn("item_id", item_id("url", "title", "content")).select(*RAW_COLUMNS)


def backfill_filter(df: DataFrame, ctx: RunContext, column: str = "published_at") -> DataFrame:
    """Keep rows published at or after ``run_date - backfill_days`` (inclusive). A literal bound, so it is
    pushed to the Parquet scan when the column is stored (F1)."""
    return df.filter(F.col(column) >= F.lit(ctx.cutoff).cast("timestamp"))


def drop_empty_content(df: DataFrame, column: str = "content") -> DataFrame:
    """Entries without content are skipped (F2)."""
    return df.filter(F.col(column).isNotNull() & (F.length(F.col(column)) > 0))


def union_collectors(*frames: DataFrame) -> DataFrame:
    """Bag union of collector outputs by column name (U1–U3); no shuffle."""
    frames = [f for f in frames if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def collect(frames: list[DataFrame], ctx: RunContext) -> DataFrame:
    """Raw items of a run: union of collectors, window filter, then the empty-content drop."""
    return drop_empty_content(backfill_filter(union_collectors(*frames), ctx))


def collector_stats(items: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Items and errors per source (A19): one row per (source_type, source_id)."""
    per_items = items.groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("items"))
    if errors is None:
        return per_items.withColumn("errors", F.lit(0).cast("long"))
    per_err = errors.groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("errors"))
    return (per_items.join(per_err, ["source_type", "source_id"], "full_outer")
            .select("source_type", "source_id", F.coalesce("items", F.lit(0)).alias("items"),
                    F.coalesce("errors", F.lit(0)).alias("errors")))


def feed_coverage(feeds: DataFrame, items: DataFrame, feed_key: str = "name", item_key: str = "source_id") -> DataFrame:
    """Every configured feed with its item count; feeds without any item get 0 (J3 and its anti-join side).

    Items are pre-aggregated per source before the join, so the join side is one row per source whatever the
    item volume; the feed list side is the configuration table."""
    counts = items.groupBy(F.col(item_key).alias("_k")).agg(F.count(F.lit(1)).alias("items"))
    return (feeds.join(counts, feeds[feed_key] == counts["_k"], "left")
            .drop("_k")
            .withColumn("items", F.coalesce(F.col("items"), F.lit(0)).cast("long")))


def feeds_without_items(feeds: DataFrame, items: DataFrame, feed_key: str = "name", item_key: str = "source_id") -> DataFrame:
    """Configured feeds that produced nothing (left anti join)."""
    keys = items.select(F.col(item_key).alias("_k")).distinct()
    return feeds.join(keys, feeds[feed_key] == keys["_k"], "left_anti")
