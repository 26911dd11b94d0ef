"""Exact de-duplication by item id.

Merge rule per item id:
* one member: the row passes unchanged;
* several members: the primary row is the one with the longest content, ties going to the first seen
  (smallest ``seq``); it supplies source_type, source_id, title, content, author. published_at is the earliest
  of the group, url the primary's (else the smallest of the group's urls), and raw_metadata lists the distinct
  sources, source ids and non-empty urls (sorted) plus one metadata entry per "source_type:source_id", the
  last seen (largest seq) winning.

Rows are told apart by a row number of their own (``_row``), not by ``seq``: collectors may give equal numbers to rows of
different feeds. Ties between rows of equal length and ``seq`` go by a hash of source and content, so they do not depend on
the order of arrival.

Plan: the raw rows are stored once (they are needed twice, and the row number must not change between the two reads). Then
two aggregation levels over slim rows (ids, lengths, urls, small metadata – no content). Level 1 groups by
(item_id, source_type, source_id) with partial (map-side) aggregation, so a hot item id is reduced to one row per
source per task before any row moves. Level 2 groups those few rows by item_id. The merged lists are bounded by
the number of distinct sources of an item, never by its row count. The order of rows is one DECIMAL, so both levels hash
instead of sorting where no list is asked for. The primary row's wide columns are joined back on ``_row``, which is unique,
so a hot item id spreads over all join partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from articleflow.operators.collect import RAW_COLUMNS
from articleflow.schemas import ENTRY_METADATA
from articleflow.session import materialize


def entry_meta(col: str = "raw_metadata") -> F.Column:
    m = F.col(col)
    return F.struct(*[m.getField(f.name).alias(f.name) for f in ENTRY_METADATA.fields])


def _rank_key(content: F.Column, seq: F.Column) -> F.Column:
    # larger is better: longer content, then smaller seq
    return F.struct(F.length(F.coalesce(content, F.lit(""))).alias("len"), (-seq).alias("neg_seq"))


_SEQ_END = (1 << 63) - 1


def _decimal(number: int) -> F.Column:
    return F.lit(str(number)).cast("decimal(38,0)")


def preference() -> F.Column:
    """One number, larger is better: content length (10 digits), then smaller seq (19), then a hash (8) of the row."""
    tie = F.pmod(F.xxhash64("source_type", "source_id", "title", "content", "url"), F.lit(100_000_000))
    place = F.lit(_SEQ_END) - F.greatest(F.coalesce(F.col("seq"), F.lit(_SEQ_END)), F.lit(0))
    return (F.length(F.coalesce("content", F.lit(""))).cast("decimal(10,0)").cast("decimal(38,0)") * _decimal(10 ** 27)
            + place.cast("decimal(38,0)") * _decimal(10 ** 8) + tie.cast("decimal(38,0)")).cast("decimal(38,0)")


def numbered(raw: DataFrame) -> DataFrame:
    """The raw rows, stored, with a number per row (``_row``) and their order of preference (``_pref``)."""
    return materialize(raw.withColumn("_pref", preference()).withColumn("_row", F.monotonically_increasing_id()), "raw")


def dedup_groups(rows: DataFrame) -> DataFrame:
    """One row per item id of ``numbered`` rows with the aggregated parts of the merge (slim columns only: no content)."""
    url_ok = F.when(F.col("url").isNotNull() & (F.col("url") != ""), F.col("url"))
    slim = rows.select("item_id", "source_type", "source_id", "seq", "published_at", "_pref", "_row", url_ok.alias("url"),
                       entry_meta().alias("meta"))
    level1 = slim.groupBy("item_id", "source_type", "source_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_pref").alias("best"),
        F.max_by("_row", "_pref").alias("best_row"),
        F.min("published_at").alias("first_published"),
        F.collect_set("url").alias("urls"),
        F.max_by("meta", "seq").alias("last_meta"),
        F.min("seq").alias("min_seq"),
    )
    return level1.groupBy("item_id").agg(
        F.sum("n").alias("n"),
        F.max_by("best_row", "best").alias("primary_row"),
        F.min("first_published").alias("published_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("all_urls"),
        F.array_sort(F.collect_set("source_type")).alias("merged_from_sources"),
        F.array_sort(F.collect_set("source_id")).alias("merged_from_ids"),
        F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws(":", "source_type", "source_id").alias("key"), F.col("last_meta").alias("value")
        ))).alias("source_metadata"),
        F.min("min_seq").alias("seq"),
    )


def dedup_exact(raw: DataFrame) -> DataFrame:
    """Raw items → one item per id (A1–A7). Output has the raw item columns plus ``n_merged``.

    The aggregation runs on slim rows; the primary row (with its content) is then fetched by an equi-join on its row
    number, so the wide columns are shuffled once and never go through the aggregation."""
    rows = numbered(raw)
    return merge_primary(rows, dedup_groups(rows))


def merge_primary(rows: DataFrame, g: DataFrame) -> DataFrame:
    """The merged row of every group in ``g`` (columns of ``dedup_groups``; ``item_id`` may name the group otherwise)."""
    fat = rows.select("_row", F.col("item_id").alias("p_item_id"), "source_type", "source_id", "title", "content", "author",
                      F.col("url").alias("p_url"), F.col("published_at").alias("p_published_at"),
                      F.col("raw_metadata").alias("p_meta"))
    # the slim side is hashed, so that the rows with their contents are neither sorted nor spilled
    return merged_items(g.hint("shuffle_hash").join(fat, g["primary_row"] == fat["_row"]))


def merged_items(groups: DataFrame) -> DataFrame:
    """The output row of every group: its merged parts beside the columns of its primary row (``p_*`` where both have one)."""
    single = F.col("n") == 1
    merged_meta = F.struct(
        F.lit(None).cast("string").alias("feed_name"), F.lit(None).cast("string").alias("feed_title"),
        F.lit(None).cast("string").alias("entry_id"), F.lit(None).cast("array<string>").alias("tags"),
        F.col("merged_from_sources"), F.col("merged_from_ids"), F.col("all_urls"), F.col("source_metadata"),
    )
    own_url = F.when(F.col("p_url").isNotNull() & (F.col("p_url") != ""), F.col("p_url"))
    return groups.select(
        "source_type", "source_id", F.col("p_item_id").alias("item_id"), "title", "content", "author",
        F.when(single, F.col("p_published_at")).otherwise(F.col("published_at")).alias("published_at"),
        F.when(single, F.col("p_url")).otherwise(F.coalesce(own_url, F.try_element_at("all_urls", F.lit(1)))).alias("url"),
        F.when(single, F.col("p_meta")).otherwise(merged_meta).alias("raw_metadata"),
        F.col("seq"),
        F.col("n").alias("n_merged"),
    )


def semantic_dedup(items: DataFrame, components: DataFrame) -> DataFrame:
    """Items → one item per component of near duplicates, merged by the rule of ``dedup_exact`` (V3, V4). ``components`` is
    (id, component) on ``item_id``; items without a component stay as they are. Output as ``dedup_exact``."""
    own = components.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    rows = numbered(items.select(*RAW_COLUMNS).join(own, F.col("item_id") == F.col("_id"), "left")
                    .withColumn("_group", F.coalesce("_component", "item_id")).drop("_id", "_component"))
    return merge_primary(rows, dedup_groups(rows.withColumn("item_id", F.col("_group"))))


def dedup_stats(raw: DataFrame, deduped: DataFrame | None = None) -> DataFrame:
    """input_count, output_count, duplicates_merged and reduction_pct in one row.

    Computed from the level-1 aggregation of the same plan: the input is counted once, groups once."""
    groups = raw.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")) if deduped is None \
        else deduped.select(F.col("n_merged").alias("n"))
    s = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("input_count"),
                   F.count(F.lit(1)).alias("output_count"))
    return s.select(
        "input_count", "output_count",
        (F.col("input_count") - F.col("output_count")).alias("duplicates_merged"),
        reduction_pct(F.col("input_count"), F.col("output_count")).alias("reduction_pct"),
    )


def reduction_pct(n_in: F.Column, n_out: F.Column) -> F.Column:
    """round((1 - out/in) * 100, 1), 0 for empty input."""
    return F.when(n_in > 0, F.round((F.lit(1.0) - n_out / n_in) * 100, 1)).otherwise(F.lit(0.0))


def primary_rows(raw: DataFrame, method: str = "aggregate") -> DataFrame:
    """The primary row of every duplicate group (W2 / A2), with its rank inputs.

    ``aggregate`` (default) uses max_by with partial aggregation and copes with a hot id; ``window`` is the
    row_number form, which sorts a whole group inside one task and is only for small or unskewed inputs."""
    if method == "window":
        w = Window.partitionBy("item_id").orderBy(F.desc(F.length("content")), F.asc("seq"))
        return (raw.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
                .select(*RAW_COLUMNS))
    row = F.struct(*[F.col(c) for c in RAW_COLUMNS])
    best = raw.groupBy("item_id").agg(F.max_by(row, _rank_key(F.col("content"), F.col("seq"))).alias("r"))
    return best.select("r.*")


def with_recency_rank(df: DataFrame, column: str = "published_at") -> DataFrame:
    """Position in newest-first order as a column (order-insensitive form of L1), numbered without a
    single-partition window (see ``ordering.global_rank``)."""
    from articleflow.operators.ordering import global_rank

    # the rank needs the key and the order columns only; it is joined back on the id, unique after dedup
    slim = materialize(df.select("item_id", column, "seq"), "recency")
    ranked = global_rank(slim, [F.desc(column), F.asc("seq"), F.asc("item_id")], "recency_rank", stage_input=False)
    if set(df.columns) <= {"item_id", column, "seq"}:
        return ranked
    return df.join(ranked.select("item_id", "recency_rank"), "item_id")
