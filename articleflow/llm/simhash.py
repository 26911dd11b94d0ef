"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprint: ASCII-lower-cased words, shingles of ``shingle`` words (repeats count), XXH64 with seed 42; a bit is set when more
than half of the shingle hashes have it. Two fingerprints link when at most ``max_bits`` bits differ.

Let r = max_bits // 2. Every distinct fingerprint emits the variants within half the radius, the variants are shuffled, and
fingerprints that meet at a variant are compared. For an odd ``max_bits`` the balls of radius r miss pairs at the full
distance 2r + 1, and full balls of radius r + 1 would be 2,081 rows a fingerprint. Two exact steps avoid that:

1. ``meeting``: the odd differing bit is masked. The 64 bits are cut into ``groups`` runs; with the run that
   holds one of the differing bits masked, at most 2r bits differ, so the balls of radius r over the other bits meet. A
   fingerprint emits 131 variants for max_bits = 3, and only fingerprints that meet another one go on. (For an
   even ``max_bits`` plain balls already meet, and this step only thins out.)
2. ``links``: what is left emits its full ball of radius r plus those r + 1 flips that lie inside one half of the 64 bits.
   Of 2r + 1 differing bits at least r + 1 share a half, so every linked pair meets at a variant that one side
   reaches with at most r flips and the other with at most r + 1. Within a variant every fingerprint links to the
   smallest one at most r flips away (the hub): their flips sum to at most max_bits, so each link is right (the distance is
   checked all the same), and both sides of each true pair reach the same hub. A variant can only be reached by as many
   fingerprints as a ball holds, so no bucket grows with the data and no pairs are enumerated.

Copies share a fingerprint, so a group of copies of any size is one fingerprint here; its rows meet again only in the last
join, which Spark can split by rows. Components come from ``components``.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle hash as one
sequence; repeated rows get equal results; a null id never becomes a component id unless its component has no other. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import map_texts, slices, texts
from articleflow.llm.components import components
from articleflow.session import materialize

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_PLACE = np.arange(8) * 256


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = [digest(joined, SEED)]
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[shingle:])]
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((values + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS  # [byte, bit]
    return int.from_bytes(np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) per row of ``docs``, ``fp`` as a signed long."""
    def run(batch: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))]

    return map_texts(docs, [id_col], text_col, run, "fp long", [dict(docs.select(id_col).dtypes)[id_col]])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def masked_variants(max_bits: int, groups: int = 3) -> list[tuple[int, int]]:
    """(bits kept, bits flipped and tag) of the first step."""
    radius, cuts = max_bits // 2, [64 * g // groups for g in range(groups + 1)]
    runs = [range(a, b) for a, b in zip(cuts, cuts[1:])] if max_bits % 2 else [range(0)]
    out = []
    for run in runs:
        kept = [b for b in range(64) if b not in run]
        tag = _mask(run[:1])  # tells the masks' variants apart
        out += [(_signed(_mask(kept)), _signed(_mask(flips) | tag))
                for size in range(radius + 1) for flips in combinations(kept, size)]
    return out


def ball_variants(max_bits: int) -> list[tuple[int, int]]:
    """(flipped bits, how many) of the second step."""
    radius = max_bits // 2
    out = [(_signed(_mask(f)), size) for size in range(radius + 1) for f in combinations(range(64), size)]
    if max_bits % 2:
        out += [(_signed(_mask(f)), radius + 1) for half in (range(32), range(32, 64))
                for f in combinations(half, radius + 1)]
    return out


def _table(rows: list[tuple[int, int]], first: str, second: str):
    """Pairs of numbers as one array constant (a single literal, folded when the plan is made)."""
    text = json.dumps([{first: a, second: b} for a, b in rows])
    return F.from_json(F.lit(text), f"array<struct<{first}:bigint,{second}:bigint>>")


def meeting(distinct: DataFrame, max_bits: int = 3, groups: int = 3) -> DataFrame:
    """The fingerprints (fp) that meet another one at a masked variant."""
    spots = _table(masked_variants(max_bits, groups), "kept", "flip")
    # a small table in few files becomes many rows here, so it is spread over the shuffle partitions first
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    emitted = spread.select("fp", F.explode(F.transform(spots, lambda s: F.col("fp").bitwiseAND(s["kept"])
                                                        .bitwiseXOR(s["flip"]))).alias("variant"))
    w = Window.partitionBy("variant")
    return (emitted.withColumn("_lo", F.min("fp").over(w)).withColumn("_hi", F.max("fp").over(w))
            .filter(F.col("_lo") != F.col("_hi")).select("fp").distinct())


def hub_links(candidates: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): every fingerprint with the hubs of its variants. They connect exactly the components of the relation "at most
    ``max_bits`` bits differ", but a fingerprint in a dense group has a hub for nearly every variant."""
    radius = max_bits // 2
    spots = _table(ball_variants(max_bits), "flip", "n")
    spread = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    emitted = spread.select("fp", F.explode(F.transform(spots, lambda s: F.struct(
        F.col("fp").bitwiseXOR(s["flip"]).alias("variant"), s["n"].alias("n")))).alias("v")).select("fp", "v.*")
    hub = F.min(F.when(F.col("n") <= radius, F.col("fp"))).over(Window.partitionBy("variant"))
    return (emitted.withColumn("hub", hub).filter(F.col("hub") != F.col("fp"))
            .filter(F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= max_bits)
            .select(F.col("fp").alias("a"), F.col("hub").alias("b")))


def links(candidates: DataFrame, max_bits: int = 3) -> DataFrame:
    """``hub_links`` without repeats."""
    return hub_links(candidates, max_bits).distinct()


def contracted(near: DataFrame, times: int = 2) -> DataFrame:
    """(a, b) links with the components of hub links, fewer where groups are dense: a fingerprint and all its hubs are linked to the
    smallest of them, and the same again with the links so made. Members of a dense group share their small hubs, so its links
    shrink to a few per fingerprint before any join. The lists are bounded: a fingerprint has at most as many hubs as variants (1,057
    for three bits), and then at most one smallest one for each fingerprint that may link to it (43,745)."""
    for _ in range(times):
        hubs = near.groupBy("a").agg(F.collect_set("b").alias("hubs"))
        least = hubs.select("a", "hubs", F.least("a", F.array_min("hubs")).alias("least"))
        star = F.transform(F.array_append("hubs", F.col("a")), lambda x: F.struct(x.alias("a"), F.col("least").alias("b")))
        near = least.select(F.inline(star)).filter(F.col("a") != F.col("b")).distinct()
    return near


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, groups: int) -> DataFrame:
    """(doc_id, fp, component_id, root) per row of ``docs``; ``root`` names the component by a fingerprint."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fps = materialize(fingerprints(own, "doc_id", "text", shingle), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    survivors = materialize(meeting(distinct, max_bits, groups), "simhash-meeting")
    roots = components(contracted(hub_links(survivors, max_bits))).withColumnRenamed("node", "fp")
    smallest = roots.join(distinct, "fp").groupBy("root").agg(F.min("rep").alias("cid"))
    grouped = roots.join(smallest, "root").select("fp", "root", "cid")
    # stored, so that the last join is a plain one of two tables, which Spark can split where a group of copies is large
    classes = materialize(distinct.join(grouped, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("cid")).alias("component_id"),
        F.coalesce("root", "fp").alias("root")), "simhash-classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, groups: int = 3) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; ``component_id`` is the smallest id that links lead to."""
    found = _classes(docs, id_col, text_col, shingle, max_bits, groups)
    return found.select(F.col("doc_id").alias(id_col), "fp", "component_id")


def with_fingerprint(docs: DataFrame, text_col: str, shingle: int, name: str) -> DataFrame:
    """``docs`` with the fingerprint as a further column."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for part in slices(batches, at):
            found = np.array([fingerprint(t, shingle) for t in texts(part.column(at))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*names, name])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Ids that stand for one row each are kept by a join on the id. Rows whose id repeats (null ids too) are told apart by
    fingerprint: of a component's rows with the kept id the smallest fingerprint stays, and of those the first by text."""
    names, same = docs.columns, [F.col(f"`{c}`") for c in docs.columns]
    rows = materialize(_classes(docs, id_col, text_col, shingle, max_bits, 3), "simhash-rows")
    heads = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    per_id = rows.groupBy(F.col("doc_id").alias("__sim_id")).agg(F.count(F.lit(1)).alias("__sim_n"))
    repeated = materialize(per_id.filter((F.col("__sim_n") > 1) | F.col("__sim_id").isNull()).select("__sim_id"), "simhash-repeated")
    alone = materialize(heads.join(repeated, F.col("doc_id").eqNullSafe(F.col("__sim_id")), "left_anti")
                        .select(F.col("doc_id").alias("__sim_id")), "simhash-kept")
    # the kept ids have no size bound, so they are never broadcast: the same shuffle join at every size
    single = docs.join(alone.hint("merge"), F.col(id_col) == F.col("__sim_id")).select(*same)
    chosen = materialize(heads.join(repeated, F.col("doc_id").eqNullSafe(F.col("__sim_id")), "left_semi")
                         .groupBy("doc_id", "root").agg(F.min("fp").alias("fp"))
                         .select(F.col("doc_id").alias("__sim_id"), F.col("fp").alias("__sim_kept")), "simhash-chosen")
    several = docs.join(repeated, F.col(id_col).eqNullSafe(F.col("__sim_id")), "left_semi")
    several = with_fingerprint(several, text_col, shingle, "__sim_fp").join(
        chosen, F.col(id_col).eqNullSafe(F.col("__sim_id")) & (F.col("__sim_fp") == F.col("__sim_kept")))
    w = Window.partitionBy(id_col, "__sim_fp").orderBy(F.asc_nulls_last(text_col), *[F.col(f"`{c}`").cast("string") for c in names])
    return single.unionByName(several.withColumn("__sim_rank", F.row_number().over(w))
                              .filter(F.col("__sim_rank") == 1).select(*same))
