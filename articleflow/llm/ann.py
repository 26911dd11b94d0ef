"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of the vectors (``pivots``, chosen by hash). A vector is represented by the order in which
the pivots lie around it: its permutation, kept as each pivot's rank. Every vector is posted in the inverted files of its
``posted`` nearest pivots, with its permutation. A query reads the files of its ``probed`` nearest pivots. In a file,
candidates are ranked by the footrule distance (sum of rank differences) to the query's permutation; those within the
query's footrule bound are reranked by the exact Euclidean distance in double precision, and the ``k`` best of each
file meet in one small merge. A candidate posted in several probed files is judged in the first of them only.

The footrule bound comes from a bounded sample of vectors (``calibration`` rows, chosen by hash): it is the ``share``
quantile of the query's footrule distances to the sample, or the largest footrule distance among the sample's 2k nearest
vectors if that is more. The second part widens the bound for queries inside a dense group, whose permutations hardly
differ. The bound limits how far down the ranking reranking goes, by distance and not by count. A query that found fewer than ``k`` neighbours is answered exactly by a scan in blocks. ``share=1`` with ``probed`` and
``posted`` at ``pivots`` makes the index exact.

Hot vectors: rows that repeat an id and its vector count once, and of equal vectors only the k + 1 smallest ids can be in any
answer (ties go to smaller ids, one may be the query's own), so only those are posted; each stands for a distance that its
copies share. Files are salted into blocks of about ``block_rows`` vectors, and every block sees only the queries that
probe its pivot, so a file that holds a third of all vectors is many tasks of bounded size.

Defined results: vectors that are null, empty, all zero, of another length than most vectors or hold null or non-finite
components take no part, as queries or candidates; rows with a null id neither; a query never finds its own id; with
fewer than ``k`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.session import materialize

FOUND = "query_id long, vec_id long, score double"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, repeated rows once."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0.0)
    return (df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(fine & some)
            .select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).dropDuplicates(["vec_id", "vec"]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _by_hash(df: DataFrame, n: int, salt: int) -> np.ndarray:
    """At most ``n`` vectors of a table that holds each vector once, the first by hash."""
    rows = df.select("vec").orderBy(F.xxhash64("vec", F.lit(salt)), "vec").limit(n).collect()
    return np.array(sorted(tuple(r["vec"]) for r in rows), dtype=np.float64)


def ranks(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): the pivots by nearness, and each pivot's rank."""
    far = (pivots ** 2).sum(axis=1)[None, :] - 2 * np.einsum("ij,kj->ik", vectors, pivots)
    order = np.argsort(far, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(pivots)), order.shape).copy(), axis=1)
    return order, place.astype(np.int16)


def footrule(places: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.abs(places - place).sum(axis=1, dtype=np.int32)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(dist) > 4 * k:  # everything up to the k-th distance, so that ties stay together
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        return near[np.lexsort((ids[near], dist[near]))[:k]]
    return np.lexsort((ids, dist))[:k]


def _merge(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _cast_like(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id",
           vec_col: str = "embedding", pivots: int = 256, posted: int = 8, probed: int = 64, share: float = 0.08,
           calibration: int = 4096, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id satisfies ``is_query``, against all rows."""
    spark = vectors.sparkSession
    every = materialize(valid_vectors(vectors, id_col, vec_col), "vectors")
    # of equal vectors the k + 1 smallest ids; Spark cuts to them before it shuffles
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = materialize(every.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1), "distinct-vectors")
    # the samples are taken from different vectors: copies of one vector must not crowd out the others
    sizes = few.filter("_n = 1").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["d"]  # the length that most vectors have
    every, few = every.filter(F.size("vec") == dim), few.filter(F.size("vec") == dim)
    different = few.filter("_n = 1")
    pivot_rows, sample = _by_hash(different, pivots, 1), _by_hash(different, calibration, 2)
    n_pivots, posted, probed = len(pivot_rows), min(posted, len(pivot_rows)), min(probed, len(pivot_rows))
    shared = spark.sparkContext.broadcast((pivot_rows, ranks(sample, pivot_rows)[1], sample))  # bounded by the parameters
    at_least = min(len(sample), 20 * k) / len(sample)

    exact_type = np.float32 if dict(vectors.dtypes)[vec_col] == "array<float>" else np.float64  # keeps all digits
    place_type = np.uint8 if n_pivots <= 256 else np.int16

    def post(batches):
        centre = shared.value[0]
        for b in batches:
            if b.num_rows:
                own = _matrix(b.column(1), dim)
                order, place = ranks(own, centre)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([v.tobytes() for v in own.astype(exact_type)], pa.binary()),
                     pa.array(list(order[:, :posted].astype(np.int32)), pa.list_(pa.int32())),
                     pa.array([p.tobytes() for p in place.astype(place_type)], pa.binary())],
                    names=["vec_id", "raw", "near", "place"])

    def ask(batches):
        centre, calibrated, known = shared.value
        for b in batches:
            if b.num_rows:
                own = _matrix(b.column(1), dim)
                order, place = ranks(own, centre)
                bound = []
                for vector, p in zip(own, place):
                    foot, dist = footrule(calibrated, p), distances(known, vector)
                    closest = np.argsort(dist, kind="stable")[:2 * k]
                    bound.append(float(max(np.quantile(foot, max(share, at_least), method="higher"), foot[closest].max())))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([v.tobytes() for v in own.astype(exact_type)], pa.binary()),
                     pa.array(list(order[:, :probed].astype(np.int32)), pa.list_(pa.int32())),
                     pa.array([p.tobytes() for p in place.astype(place_type)], pa.binary()), pa.array(bound)],
                    names=["vec_id", "raw", "near", "place", "bound"])

    row = "vec_id long, raw binary, near array<int>, place binary"
    indexed = materialize(few.drop("_n").mapInArrow(post, row), "permutations")
    asked = materialize(every.filter(is_query(F.col("vec_id"))).repartition(_width(spark), "vec_id")
                        .mapInArrow(ask, row + ", bound double"), "queries")
    # files are cut into blocks of vectors and their queries into blocks of queries: one row per pivot decides how many
    n_blocks, n_asks = (_blocks(t, n_pivots, block_rows) for t in (indexed, asked))
    left = (indexed.select("vec_id", "raw", "near", "place", F.explode("near").alias("pivot"))
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int"))
            .select("*", F.explode(F.sequence(F.lit(0), n_asks - 1)).alias("ask")))
    right = (asked.select("vec_id", "raw", "near", "place", "bound", F.explode("near").alias("pivot"))
             .withColumn("ask", F.pmod(F.xxhash64("vec_id"), n_asks).cast("int"))
             .select("*", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")))

    def judge(key, own: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(qs):
            pivot = key[0]
            ids, vecs = own["vec_id"].to_numpy(), _vectors(own["raw"], exact_type)
            near = np.stack(own["near"].to_numpy())
            places = np.frombuffer(b"".join(own["place"]), place_type).reshape(len(ids), -1).astype(np.int16)
            before = np.cumsum(near == pivot, axis=1) == 0  # files in which a candidate stands before this one
            for q in qs.itertuples():
                reads = np.zeros(n_pivots, bool)
                reads[np.asarray(q.near)] = True
                mine = (ids != q.vec_id) & ~(reads[near] & before).any(axis=1)
                spots = np.flatnonzero(mine)
                spots = spots[footrule(places[spots], np.frombuffer(q.place, place_type).astype(np.int16)) <= q.bound]
                dist = distances(vecs[spots], np.frombuffer(q.raw, exact_type).astype(np.float64))
                best = _best(dist, ids[spots], k)
                out.append(pd.DataFrame({"query_id": q.vec_id, "vec_id": ids[spots][best], "score": dist[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["pivot", "block", "ask"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(judge, FOUND)
    ranked = materialize(_merge(found.dropDuplicates(["query_id", "vec_id"]), k), "neighbours")
    total = indexed.select("vec_id").distinct().count()
    enough = ranked.groupBy("query_id").count().filter(F.col("count") >= min(k, max(0, total - 1)))
    short = asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "raw")
    if short.isEmpty():
        return _cast_like(ranked)
    exact = exact_search(indexed.select("vec_id", "raw"), short, k, exact_type)
    return _cast_like(ranked.join(enough, "query_id", "left_semi").unionByName(exact))


def _vectors(raw: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _blocks(table: DataFrame, n_pivots: int, block_rows: int) -> Column:
    counts = {r["pivot"]: r["count"] for r in table.select(F.explode("near").alias("pivot")).groupBy("pivot").count().collect()}
    sizes = [x for p in range(n_pivots) for x in (p, max(1, -(-counts.get(p, 0) // block_rows)))]
    return F.element_at(F.create_map(*[F.lit(x) for x in sizes]), F.col("pivot"))


def _width(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, kind=np.float64, per_block: int = 1024) -> DataFrame:
    """Exact neighbours (query_id, vec_id, score, rank) of (vec_id, raw) rows by a scan: every block of queries meets every
    block of vectors."""
    n_q = max(1, -(-queries.count() // per_block))
    n_v = max(1, -(-vectors.count() // (16 * per_block)))
    left = (vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(n_v)).cast("int"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb")))
    right = (queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int"))
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb")))

    def judge(key, own: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(qs):
            ids, vecs = own["vec_id"].to_numpy(), _vectors(own["raw"], kind)
            for q in qs.itertuples():
                spots = np.flatnonzero(ids != q.vec_id)
                dist = distances(vecs[spots], np.frombuffer(q.raw, kind).astype(np.float64))
                best = _best(dist, ids[spots], k)
                out.append(pd.DataFrame({"query_id": q.vec_id, "vec_id": ids[spots][best], "score": dist[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(judge, FOUND)
    return _merge(found.dropDuplicates(["query_id", "vec_id"]), k).select("query_id", "vec_id", "score", "rank")
