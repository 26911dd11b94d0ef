"""Publication: API projection, distributions, run statistics, topic groups and the payload
(A9–A13, A17, W1, P11–P15, S12, U4, R4, R5).

Table forms are the defaults: distributions as one long table, topic groups as (topic, rank, item) rows.
The payload is written as JSON lines (one line per meta/stats record, item and error), so no section of a
large run is gathered into one row, one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.context import RunContext
from articleflow.functions.arrays import primary_topic
from articleflow.functions.dates import iso_format
from articleflow.operators.ordering import rank_within
from articleflow.session import materialize
from articleflow.schemas import ARTICLE_TYPES, PAYLOAD_VERSION, TOPIC_CATEGORIES, UNKNOWN


def api_items(processed: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Processed items as API records: renamed columns, ISO times, no embedding."""
    return processed.select(
        F.col("item_id").alias("id"), "title", "summary", "key_points", "topics", "article_type",
        F.col("original_urls").alias("urls"), F.col("source_types").alias("sources"),
        iso_format("published_at").alias("published_at"), iso_format("processed_at").alias("processed_at"),
        *(extra or []),
    )


def vocabulary(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """Literal table of a fixed vocabulary with its position (U4)."""
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], f"{name} string, position int")


def _with_zero_rows(counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts plus a 0 row for every vocabulary value (U4): union with the literal vocabulary and sum, which
    needs no join (a full outer join cannot broadcast its small side)."""
    vocab = vocabulary(counts.sparkSession, values, key).select(key, F.lit(0).cast("long").alias("n"))
    return (counts.select(key, F.col("n").cast("long")).unionByName(vocab)
            .groupBy(key).agg(F.sum("n").cast("long").alias("n")))


def topic_distribution(processed: DataFrame, with_vocabulary: bool = False) -> DataFrame:
    """Every topic of every item counts, repeats included (A9). With ``with_vocabulary`` the ten categories
    appear with 0 when unused."""
    counts = (processed.select(F.explode("topics").alias("topic"))
              .groupBy("topic").agg(F.count(F.lit(1)).alias("n")))
    if not with_vocabulary:
        return counts
    return _with_zero_rows(counts, "topic", TOPIC_CATEGORIES)


def source_distribution(processed: DataFrame) -> DataFrame:
    """Count per source type over the source lists (A10)."""
    return (processed.select(F.explode("source_types").alias("source"))
            .groupBy("source").agg(F.count(F.lit(1)).alias("n")))


def type_distribution(processed: DataFrame, with_vocabulary: bool = False) -> DataFrame:
    """Count per article type, missing type → 'unknown' (A11)."""
    counts = (processed.select(F.coalesce(F.col("article_type"), F.lit(UNKNOWN)).alias("article_type"))
              .groupBy("article_type").agg(F.count(F.lit(1)).alias("n")))
    if not with_vocabulary:
        return counts
    return _with_zero_rows(counts, "article_type", ARTICLE_TYPES)


def run_stats_long(processed: DataFrame, persisted_count: DataFrame | int | str = 0,
                   errors: DataFrame | None = None) -> DataFrame:
    """Run statistics as one long table (dimension, value, n) (A12): total_items, persisted_count,
    collection_errors and the topic / source / article-type distributions.

    One pass over the items: each item is exploded into its (dimension, value) markers and a single aggregation
    counts them (partial aggregation map-side), so the item frame is read once whatever the number of
    dimensions. The three scalar rows are always present (0 when nothing was counted). ``persisted_count`` is a
    number, a one-row frame with column ``n``, or ``"items"`` when every item counts as persisted."""
    spark = processed.sparkSession

    def marker(dim, value):
        return F.struct(F.lit(dim).alias("dimension"), value.cast("string").alias("value"))

    markers = [F.array(marker("total_items", F.lit(None))),
               F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: marker("topic", t)),
               F.transform(F.coalesce("source_types", F.array().cast("array<string>")), lambda t: marker("source", t)),
               F.array(marker("article_type", F.coalesce(F.col("article_type"), F.lit(UNKNOWN))))]
    if persisted_count == "items":
        markers.append(F.array(marker("persisted_count", F.lit(None))))
    rows = (processed.select(F.explode(F.concat(*markers)).alias("m"))
            .select("m.dimension", "m.value", F.lit(1).cast("long").alias("one")))
    zeros = spark.createDataFrame([("total_items", None, 0), ("persisted_count", None, 0), ("collection_errors", None, 0)],
                                  "dimension string, value string, one long")
    rows = rows.unionByName(zeros)
    if errors is not None:
        rows = rows.unionByName(errors.select(F.lit("collection_errors").alias("dimension"),
                                              F.lit(None).cast("string").alias("value"), F.lit(1).cast("long").alias("one")))
    if isinstance(persisted_count, DataFrame):
        rows = rows.unionByName(persisted_count.select(F.lit("persisted_count").alias("dimension"),
                                                       F.lit(None).cast("string").alias("value"),
                                                       F.col("n").cast("long").alias("one")))
    elif isinstance(persisted_count, int) and persisted_count:
        rows = rows.unionByName(spark.createDataFrame([("persisted_count", None, int(persisted_count))],
                                                      "dimension string, value string, one long"))
    return rows.groupBy("dimension", "value").agg(F.sum("one").cast("long").alias("n"))


def run_stats_row(stats_long: DataFrame) -> DataFrame:
    """The nested stats record of the payload from the long table: scalars and three maps.
    Map sizes are bounded by the distinct topics / sources / types."""
    def dist(dim):
        return F.map_from_entries(F.collect_list(F.when(F.col("dimension") == dim, F.struct("value", "n"))))

    def scalar(dim):
        return F.coalesce(F.max(F.when(F.col("dimension") == dim, F.col("n"))), F.lit(0))

    return stats_long.agg(
        scalar("total_items").alias("total_items"), scalar("persisted_count").alias("persisted_count"),
        scalar("collection_errors").alias("collection_errors"),
        dist("topic").alias("topic_distribution"), dist("source").alias("source_distribution"),
        dist("article_type").alias("article_type_distribution"),
    )


def topic_ranks(processed: DataFrame, order_by: str = "published_at", stored: bool = False) -> DataFrame:
    """(item_id, primary_topic, topic_rank), newest first (W1, P13, L3); ``order_by='relevance_score'`` ranks by score instead
    (R4), items without a score last. Only the key and the order columns are written and sorted, by a range sort and
    not by a window per topic, so one topic holding most items is still spread over many tasks. ``stored`` says that
    ``processed`` reads a stored table, which then need not be staged again."""
    order = [F.desc("published_at"), F.asc("seq"), F.asc("item_id")]
    if order_by == "relevance_score":
        order = [F.desc_nulls_last("relevance_score"), *order]
    slim = processed.select("item_id", primary_topic("topics").alias("primary_topic"), "published_at", "seq",
                            *(["relevance_score"] if order_by == "relevance_score" else []))
    ranked = rank_within(slim, ["primary_topic"], order, "topic_rank", stage_input=not stored)
    return ranked.select("item_id", "primary_topic", "topic_rank")


def by_topic_ranked(processed: DataFrame, order_by: str = "published_at", stored: bool = False) -> DataFrame:
    """Items with their primary topic and rank inside it (A13 table form): the ranks of ``topic_ranks`` joined back to
    the items, whose ids are unique after dedup. Items that are not stored yet are staged once."""
    items = processed if stored else materialize(processed, "ranked-items")
    return items.join(topic_ranks(items, order_by, stored=True), "item_id")


def by_topic_nested(ranked: DataFrame, per_topic: int) -> DataFrame:
    """Nested form of A13 for display: one row per topic holding its first ``per_topic`` items (a top-k report;
    the full grouping is the table form above)."""
    top = ranked.filter(F.col("topic_rank") <= per_topic)
    return top.groupBy("primary_topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("topic_rank", "item_id", "title"))),
                    lambda x: x.dropFields("topic_rank")).alias("items"))


def payload_counts(processed: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Items, distinct primary topics and errors of the payload (A17), as one aggregate over the union of
    item and error markers (no join of the two inputs)."""
    items = processed.select(F.lit(1).alias("_item"), primary_topic("topics").alias("_topic"), F.lit(0).alias("_err"))
    if errors is not None:
        items = items.unionByName(errors.select(F.lit(0).alias("_item"), F.lit(None).cast("string").alias("_topic"),
                                                F.lit(1).alias("_err")))
    return items.agg(F.coalesce(F.sum("_item"), F.lit(0)).cast("long").alias("item_count"),
                     F.count_distinct("_topic").alias("topic_count"),
                     F.coalesce(F.sum("_err"), F.lit(0)).cast("long").alias("error_count"))


def run_meta(spark: SparkSession, ctx: RunContext, items: DataFrame | None = None) -> DataFrame:
    """meta record: run_id (default 'unknown'), run_date, generated_at, version (P15); with ``items`` the
    record also carries the run's item count (one aggregate over the items)."""
    cols = [
        F.lit(ctx.effective_run_id).alias("run_id"),
        iso_format(F.lit(ctx.run_date).cast("timestamp")).alias("run_date"),
        iso_format(F.lit(ctx.now).cast("timestamp")).alias("generated_at"),
        F.lit(PAYLOAD_VERSION).alias("version"),
    ]
    if items is None:
        return spark.range(1).select(*cols)
    return items.agg(F.count(F.lit(1)).alias("item_count")).select(*cols, "item_count")


def error_records(errors: DataFrame) -> DataFrame:
    """Payload errors: source_type, source_id, error."""
    return errors.select("source_type", "source_id", F.col("error_message").alias("error"))


def payload_lines(spark: SparkSession, ctx: RunContext, processed: DataFrame, stats_long: DataFrame,
                  errors: DataFrame | None, stored: bool = False) -> DataFrame:
    """The publication payload as JSON lines (S12): ("meta", …), ("stats", …), one ("item", …) per item with its
    primary topic and rank, one ("error", …) per error. ``write_payload`` stores it."""
    meta = run_meta(spark, ctx).select(F.lit("meta").alias("section"), F.to_json(F.struct("*")).alias("json"))
    stats = run_stats_row(stats_long).select(F.lit("stats").alias("section"), F.to_json(F.struct("*")).alias("json"))
    ranked = by_topic_ranked(processed, stored=stored)
    items = api_items(ranked, extra=["primary_topic", "topic_rank"])
    item_lines = items.select(F.lit("item").alias("section"), F.to_json(F.struct("*")).alias("json"))
    parts = [meta, stats, item_lines]
    if errors is not None:
        parts.append(error_records(errors).select(F.lit("error").alias("section"),
                                                  F.to_json(F.struct("*")).alias("json")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_payload(lines: DataFrame, path: str) -> None:
    """Writes the payload lines as text, one ``{"section": …, "body": …}`` object per line."""
    value = F.concat(F.lit('{"section":"'), F.col("section"), F.lit('","body":'), F.col("json"), F.lit("}"))
    lines.select(value.alias("value")).write.mode("overwrite").text(path)
