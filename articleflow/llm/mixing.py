"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by that key within their source: a source's key space
is cut into equal ranges, each (source, range) is sorted on its own, and the running size inside a range plus the
sizes of the source's earlier ranges gives each document's place in its source. The mix then takes
``budget = round(target)`` words of each source: whole epochs first, then the prefix of the hash order that fits. With
``cut="word"`` the document at the border is taken in part, so the source meets its budget exactly; with
``cut="document"`` it is taken whole when that lands nearer to the budget, and left out otherwise.

Targets: sources ordered by code point (null last) weigh ``weights`` in turn and share ``share`` of all words;
a target stops at ``max_epochs`` times its source and the excess is shared again by weight until none is above.

Hot sources: a range holds about ``rows_per_range`` documents of a source whatever the source's size (keys are
uniform), so no task sorts a whole source. The number of ranges follows the row count and does not change results.

Defined results: null texts have size 0; documents of size 0 take 0 words; a null source is a source of its own, last in
order; a null id hashes like the empty text; documents with equal ids are ordered by size, and equal rows
share one outcome up to which copy comes first. An empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import WORD
from articleflow.operators.ordering import global_rank
from articleflow.session import materialize

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) per source of ``sizes`` (source, size).

    The level ``l`` with ``target = min(weight * l, cap)`` is found by rounds of one small aggregate over the
    per-source table: sources over their cap leave, the rest share what is left; it ends when no source leaves."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per, [F.col("source").isNull(), F.asc("source")], "_rank")
    place = (F.col("_rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    per = materialize(ranked.select("source", "source_size", weight.alias("_w"),
                                    (F.col("source_size") * F.lit(float(max_epochs))).alias("_cap")), "mix-sources")
    first = per.agg(F.sum("source_size"), F.sum("_w")).first()
    total, level, left_out = share * float(first[0] or 0), 0.0, -1
    if first[1]:
        level = total / first[1]
        while True:
            over = F.col("_cap") <= F.col("_w") * F.lit(level)
            caps, open_w, n = per.agg(F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w"))),
                                      F.count_if(over)).first()
            if n == left_out or not open_w:
                break
            left_out, level = n, (total - float(caps or 0)) / open_w
    return per.select("source", "source_size", F.least(F.col("_w") * F.lit(level), F.col("_cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, cut: str = "word",
        seed: str = "mix", rows_per_range: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: (id, source, size, source_size, target, taken, epochs); ``epochs`` is the number of
    times the document is taken whole."""
    slim = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
        .alias("_key")), "mix-sizes")
    targets = source_targets(slim, weights, share, max_epochs)
    digits = max(2, math.ceil(math.log(max(1, slim.count()) / rows_per_range + 1, 16)))
    rows = slim.withColumn("_range", F.substring("_key", 1, digits))
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.asc_nulls_first("doc_id"), "size")
    placed = rows.withColumn("_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
                             - F.col("size"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (rows.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
              .select("source", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")))
    r, t = ranges.alias("r"), targets.alias("t")
    joined = (placed.alias("p")
              .join(r, F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p._range") == F.col("r._range")))
              .join(t, F.col("p.source").eqNullSafe(F.col("t.source"))))
    before = F.col("_in") + F.col("_off")
    budget = F.floor(F.col("target") + 0.5)
    out = (joined.select("p.doc_id", "p.source", "size", "source_size", "target", before.alias("_before"),
                         budget.alias("_budget"))
           .withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0))
           .withColumn("_rest", F.col("_budget") - F.col("_whole") * F.col("source_size")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before")))
    if cut == "document":
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    taken = F.col("_whole") * F.col("size") + part
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
                      F.when(F.col("size") > 0, taken / F.col("size")).otherwise(F.lit(0)).cast("int").alias("epochs"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    **options) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as the mix takes it whole (``cut="document"``), with the
    columns of ``docs``. Rows that repeat an id are mixed as one group: each takes the id's epochs of its own rank
    order, so ids should be unique when sizes matter to the word."""
    taken = mix(docs, id_col, source_col, text_col, cut="document", **options)
    times = taken.groupBy("doc_id", "source", "size").agg(F.max("epochs").alias("__mix_times"))
    sized = docs.withColumn("__mix_size", word_count(F.col(text_col).cast("string"))).alias("d")
    joined = sized.join(times.alias("t"), F.col(f"d.{id_col}").eqNullSafe(F.col("t.doc_id"))
                        & F.col(f"d.{source_col}").eqNullSafe(F.col("t.source")) & (F.col("d.__mix_size") == F.col("t.size")))
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_times"))).alias("__mix_copy")
    return (joined.filter(F.col("__mix_times") > 0).select(*[F.col(f"d.`{c}`") for c in docs.columns], copies)
            .drop("__mix_copy"))
