"""Distributed ordering helpers.

``global_rank`` / ``rank_within`` number rows without a window whose partition could hold a hot key: rows are
range-sorted on (group, order) – range boundaries split even one huge group over many tasks – and each row takes
its position inside its sorted partition from ``monotonically_increasing_id`` (upper bits = partition index).
A per-(partition, group) summary (count and first position) gives, by a running sum over partitions, the
number of rows of the same group in earlier partitions; rank = that offset + position within the partition's
run of the group + 1. The summary has one row per (partition, group) pair, not per row. The sorted frame is
stored in the shared checkpoint folder first, so both uses read one materialised order and a lost
executor cannot renumber anything (written once as Parquet, see ``session.materialize``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.session import materialize

_LOW_BITS = (1 << 33) - 1


def rank_within(df: DataFrame, group_cols: list[str], order: list[Column], name: str = "rank",
                stage_input: bool = True) -> DataFrame:
    """Adds ``name`` = 1-based position of each row inside its group in ``order`` (a total order per group).

    The summary has one row per (partition, group). Without groups it is one row per partition and is broadcast;
    with groups its size depends on the group values (topics from a provider are free strings), so the join
    strategy is left to AQE, which broadcasts it only when its measured size is under the threshold.
    Pass slim rows (keys and order columns) and join the rank back to wide ones. ``stage_input`` stores the input once first, because
    the range partitioner evaluates its input once to sample boundaries and again to sort."""
    if stage_input:
        # a range sort runs its input twice (boundary sampling, then the sort): store an expensive input once
        df = materialize(df, "rank-input")
    sort_cols = [F.asc_nulls_first(c) for c in group_cols] + list(order)
    sorted_ids = (df.orderBy(*sort_cols)
                  .withColumn("_mid", F.monotonically_increasing_id())
                  .withColumn("_part", F.shiftright(F.col("_mid"), 33))
                  .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    sorted_ids = materialize(sorted_ids, "ranked")
    keys = group_cols + ["_part"]
    summary = sorted_ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    w = (Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
         if group_cols else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = summary.select(*keys, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    if not group_cols:
        offsets = F.broadcast(offsets)
    # null-safe join on the group columns (a null group is its own group)
    cond = [sorted_ids["_part"] == offsets["_part"]] + [sorted_ids[c].eqNullSafe(offsets[c]) for c in group_cols]
    joined = sorted_ids.join(offsets.select(*[F.col(c) for c in keys], "_first", "_off"), cond)
    return (joined.select(sorted_ids["*"], (F.col("_off") + F.col("_pos") - F.col("_first") + 1).alias(name))
            .drop("_mid", "_part", "_pos"))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", stage_input: bool = True) -> DataFrame:
    """Adds ``name`` = 1-based position of each row in ``order`` (which must be a total order)."""
    return rank_within(df, [], order, name, stage_input=stage_input)
