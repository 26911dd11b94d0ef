"""Vector operators on ARRAY<FLOAT> embeddings (V1–V5, J4). Ids may be of any orderable type.

* ``cosine_topk`` – exact top-k by cosine similarity to one query vector: one pass over the table and a
  TakeOrderedAndProject (per-task top-k, k rows per task merged). The query side is one row (broadcast).
* ``topk_many`` – exact top-k for a table of queries: blocks of queries against blocks of rows, k kept per query and block, merged in
  two levels.
* ``similar_pairs`` – all pairs with cosine ≥ t, exact at every threshold and also for copies. The vectors are packed into
  blocks by nearest pivot, and every two blocks are compared that can hold a pair (cosine ≥ t ⇔ distance of the unit vectors ≤
  r = sqrt(2 − 2t), and by the triangle inequality the distances of a pair to any pivot differ by r at most). The blocks are stored once
  and read for each comparison, so nothing is copied or shuffled per pair of blocks; the work is that of comparing all blocks with all
  blocks where the pivots part none, which is what an exact answer costs there. No cap, no second method.
* ``similar_links`` – links with the same components: stars for copies and a forest per task (all the pairs of blocks it
  compares), so a dense group gives links in proportion to its rows.
* ``hashed_pairs`` – random sign bits in bands with multi-probe, then exact verification: the work grows with the rows and the pairs
  found, at a stated recall.
* ``similar_pairs_exact`` – the quadratic reference; only for small inputs and tests.
* ``connected_components`` – star contraction (``operators.graph``); each step's links are written to the shared checkpoint
  folder (lineage stays short, a lost executor recomputes one step only).
* ``merge_components`` – one row per group (``dedup.semantic_dedup`` merges items by component).
* ``ivf_index`` / ``ivf_search`` – KMeans lists over unit vectors stored by list, probe the nearest lists, exact re-rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators.graph import star_components
from articleflow.schemas import IVF_LISTS, SIMILARITY_THRESHOLD
from articleflow.session import materialize, scratch_path


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v) -> Column:
    """Vector scaled to length 1 as ARRAY<DOUBLE> (null for a zero vector). The length is bound once, as the variable of
    an outer lambda; inside the element lambda it would be summed again for every element."""
    scaled = F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(
        n > 0, F.transform(_c(v), lambda x: x.cast("double") / n))), 1)
    return F.when(_c(v).isNotNull(), scaled)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _unit_literal(q: list[float]) -> Column:
    n = math.sqrt(sum(float(x) * float(x) for x in q))
    if n == 0:
        raise ValueError("query vector has length 0")
    return F.array(*[F.lit(float(x) / n) for x in q])


def cosine_topk(df: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Top ``k`` rows of ``df`` by cosine similarity to the query vector (a parameter, as in semantic search)."""
    q = _unit_literal(query)
    length = norm(F.col(vec_col))
    scored = df.select(id_col, F.when(length > 0, dot(F.col(vec_col), q) / length).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def topk_many(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
              block_rows: int = 20_000, query_block: int = 2_000) -> DataFrame:
    """(query_id, rank, id, similarity): the ``k`` rows of ``df`` nearest to every row of ``queries`` by cosine, the query's own id left
    out, nearest first, ties to the smaller id. Both tables have ``id_col`` and ``vec_col`` and may differ; other columns are ignored.
    Null and zero vectors and those holding null take no part; a query with fewer than ``k`` other rows gets them all. Repeated rows
    of ``df`` are rows of their own, a repeated query id counts as one query (any of its vectors).

    Rows are dealt evenly to blocks by their number, so neither a repeated id nor copies of one vector fill a block. A task holds one
    block of rows and one of queries and returns ``k`` candidates per query, found by selection, not by sorting the scores. The
    candidates of a query are merged first within groups of blocks, then over the groups: a task sees the root of the number of
    blocks times ``k`` of them. The shuffle before is rows x query blocks + queries x row blocks; larger blocks lower it."""
    dtype = dict(df.select(id_col).dtypes)[id_col]
    rows, n = _numbered_units(df, id_col, vec_col)
    asked, m = _numbered_units(queries.dropDuplicates([id_col]), id_col, vec_col)
    n_blocks, m_blocks = max(1, -(-n // block_rows)), max(1, -(-m // query_block))
    left = rows.select("id", "u", F.pmod("number", F.lit(n_blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(m_blocks - 1))).alias("part"))
    right = asked.select("id", "u", F.pmod("number", F.lit(m_blocks)).cast("int").alias("part"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        lambda a, b: _nearest_in_block(a, b, k), f"query_id {dtype}, block long, id {dtype}, similarity double")
    fan = max(1, math.isqrt(n_blocks))
    nearest = F.struct((-F.col("similarity")).alias("far"), F.col("id").alias("id"))
    level1 = found.groupBy("query_id", F.pmod("block", F.lit(fan)).alias("group")).agg(
        F.slice(F.array_sort(F.collect_list(nearest)), 1, k).alias("best"))
    merged = level1.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.far")).alias("similarity"))


def _numbered_units(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Unit vectors, stored, with a row number, and their count."""
    u = unit(F.col(vec_col))
    ok = F.col("u").isNotNull() & ~F.exists("u", lambda x: x.isNull() | F.isnan(x))
    stored = materialize(df.select(F.col(id_col).alias("id"), u.alias("u")).filter(ok & F.col("id").isNotNull())
                         .withColumn("number", F.monotonically_increasing_id()), "units")
    return stored, stored.count()


def _nearest_in_block(rows, queries, k: int):
    import numpy as np
    import pandas as pd

    out = pd.DataFrame(columns=["query_id", "block", "id", "similarity"])
    if rows.empty or queries.empty:
        return out
    rows = rows.sort_values("id", kind="stable")
    ids, a, asked = rows["id"].to_numpy(), np.stack(rows["u"].to_numpy()), queries["id"].to_numpy()
    b = np.stack(queries["u"].to_numpy())
    parts = []
    for start in range(0, len(b), 200):  # the scores held at a time: 200 queries against the block
        scores = np.einsum("ij,kj->ik", b[start:start + 200], a)
        for i, row in enumerate(scores, start):
            row[ids == asked[i]] = -np.inf
            limit = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            near = np.flatnonzero(row >= limit) if limit > -np.inf else np.flatnonzero(row > -np.inf)
            # ids are in order and the sort is stable, so ties at the limit go to the smaller id
            near = near[np.argsort(-row[near], kind="stable")[:k]]
            parts.append(pd.DataFrame({"query_id": asked[i], "block": rows["block"].iloc[0], "id": ids[near], "similarity": row[near]}))
    return pd.concat(parts) if parts else out


def similar_pairs_exact(df: DataFrame, threshold: float = SIMILARITY_THRESHOLD, id_col: str = "vec_id",
                        vec_col: str = "embedding") -> DataFrame:
    """All pairs (a < b) with cosine ≥ threshold by comparing every pair – quadratic, small inputs only."""
    u = df.select(F.col(id_col).alias("id"), unit(F.col(vec_col)).alias("u"))
    a, b = u.alias("a"), u.alias("b")
    pairs = a.join(b, F.col("a.id") < F.col("b.id")).select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), dot("a.u", "b.u").alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold)


def collapse_identical(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Map every row to a representative (smallest id) of its group of identical vectors: (id, rep, vector).
    The grouping key is the vector itself, aggregated map-side."""
    reps = df.groupBy(vec_col).agg(F.min(id_col).alias("rep"))
    return df.join(reps, vec_col).select(F.col(id_col).alias("id"), "rep", vec_col)


def _pivots(reps: DataFrame, n: int):
    """At most ``n`` unit vectors, the first by hash (a bounded sample; results do not depend on it)."""
    import numpy as np

    rows = _finite(reps).select("u").orderBy(F.xxhash64("u"), "u").limit(n).collect()
    return np.array([r.u for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)


def _finite(reps: DataFrame) -> DataFrame:
    """Without the vectors that hold NaN: they are similar to none."""
    return reps.filter(~F.exists("u", F.isnan))


def _distances(u, pivots):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ pivots.T)))


def _near_cells(batches, pivots, reach: float):
    """Rows of (id, u) with the number of their own cell and the list of the cells that can hold a neighbour, one row per vector. The
    distances held at a time are those of 1,024 rows."""
    import numpy as np
    import pandas as pd

    for pdf in batches:
        for at in range(0, len(pdf), 1024):
            part = pdf.iloc[at:at + 1024]
            u = np.stack(part["u"].to_numpy()).astype(np.float64)
            dist = _distances(u, pivots)
            near = dist <= dist.min(axis=1, keepdims=True) + reach
            yield pd.DataFrame({"id": part["id"].to_numpy(), "u": list(u), "own": dist.argmin(axis=1).astype(np.int32),
                                "near": [np.flatnonzero(row).astype(np.int32) for row in near]})


def _reach(threshold: float) -> float:
    """The distance of two unit vectors whose cosine is the threshold, and a little for rounding."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6


def _cells(reps: DataFrame, threshold: float, n_pivots: int) -> DataFrame:
    """(id, u, cell, home): each vector in its own cell (``home``) and in every cell that can hold a neighbour. Python returns a row per
    vector; Spark copies it to its cells."""
    centres = reps.sparkSession.sparkContext.broadcast(_pivots(reps, n_pivots))
    reach = 2 * _reach(threshold)

    placed = reps.mapInPandas(lambda batches: _near_cells(batches, centres.value, reach),
                              f"id {dict(reps.dtypes)['id']}, u array<double>, own int, near array<int>")
    return placed.select("id", "u", "own", F.explode("near").alias("cell")).select("id", "u", "cell", (F.col("cell") == F.col("own")).alias("home"))


def _representatives(members: DataFrame, vec_col: str) -> DataFrame:
    return materialize(members.filter(F.col("id") == F.col("rep")).select("id", unit(F.col(vec_col)).alias("u"))
                       .filter(F.col("u").isNotNull()), "unit-vectors")


def _merged(root, i, j):
    """Labels ``root`` (each the first row of its component) after the rows ``i`` and ``j`` were linked: minimum labels with jumps."""
    import numpy as np

    while True:
        new = root.copy()
        low = np.minimum(new[i], new[j])
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near_in_block(a, b, threshold: float):
    """(i, j, similarity) of the rows of ``a`` and ``b`` with cosine ≥ threshold, in parts of bounded size: 128 rows of ``a`` are scored
    at a time, in single precision with its rounding error to spare, and of the pairs found some megabytes of vectors are multiplied out
    in double precision, which decides."""
    import numpy as np

    step = max(1, (1 << 20) // max(1, a.shape[1]))
    low = threshold - 1e-9 - 1.2e-7 * (a.shape[1] + 4)
    rough = np.ascontiguousarray(b, dtype=np.float32).T
    for at in range(0, len(a), 128):
        rows, cols = np.divmod(np.flatnonzero((a[at:at + 128].astype(np.float32) @ rough).ravel() >= low), len(b))
        for k in range(0, len(rows), step):
            i, j = rows[k:k + step] + at, cols[k:k + step]
            similarity = (a[i] * b[j]).sum(axis=1)
            exact = similarity >= threshold
            yield i[exact], j[exact], similarity[exact]


def _compare_blocks(left, right, threshold: float, links: bool):
    """The pairs of two blocks (``id``, ``u`` and ``other``, ``w``) with id < other, or with ``links`` a forest of them: one link per
    row to the first row of its component. In one process, with plain frames; the search itself works on packed blocks (``_compared``)."""
    import numpy as np
    import pandas as pd

    if left.empty or right.empty:
        return pd.DataFrame({"id_a": left["id"][:0], "id_b": left["id"][:0], "similarity": []})
    a, b = np.stack(left["u"].to_numpy()), np.stack(right["w"].to_numpy())
    ia, ib = left["id"].to_numpy(), right["other"].to_numpy()
    if links:
        found = np.arange(len(ia) + len(ib))
        for i, j, _ in _near_in_block(a, b, threshold):
            found = _merged(found, i, j + len(ia))
        ids = np.concatenate([ia, ib])
        own = np.flatnonzero(ids != ids[found])
        return pd.DataFrame({"id_a": ids[found[own]], "id_b": ids[own], "similarity": np.nan})
    parts = []
    for i, j, similarity in _near_in_block(a, b, threshold):
        keep = ia[i] < ib[j]
        # places in a block fit into 32 bits; the ids are looked up once, at the end
        parts.append((i[keep].astype(np.int32), j[keep].astype(np.int32), similarity[keep]))
    i, j, similarity = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    return pd.DataFrame({"id_a": ia[i], "id_b": ib[j], "similarity": similarity})


#: Bytes of vectors in a block (on average): long vectors make blocks of fewer rows.
_BLOCK_BYTES = 1 << 20


def _blocks(reps: DataFrame, pivots, block: int) -> DataFrame:
    """(no, ids, u, lo, hi), stored: the vectors of a cell (those nearest to one pivot) dealt by hash to blocks of about ``block`` rows, a
    row per block with its vectors packed and the range of their distances to every pivot."""
    import numpy as np
    import pandas as pd

    spark, kind = reps.sparkSession, dict(reps.dtypes)["id"]
    centres = spark.sparkContext.broadcast(pivots)
    rows = max(1, min(block, _BLOCK_BYTES // max(8, 8 * pivots.shape[1])))

    def own(batches):
        for part in _near_cells(batches, centres.value, 0.0):
            yield part[["id", "u", "own"]]

    def pack(key, pdf):
        u = np.stack(pdf["u"].to_numpy()).astype(np.float64)
        far = _distances(u, centres.value)
        return pd.DataFrame({"no": [int(key[0]) << 32 | int(key[1])], "ids": [pdf["id"].to_numpy()], "u": [u.tobytes()],
                             "lo": [far.min(axis=0)], "hi": [far.max(axis=0)]})

    # a cell's rows are counted before they are dealt: the vectors are placed twice, but stored once
    finite = _finite(reps)
    counted = finite.mapInPandas(lambda batches: (p[["own"]] for p in own(batches)), "own int").groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.own: r.n for r in counted.collect()} if len(pivots) else {}  # one row per pivot
    if not sizes:
        return materialize(spark.createDataFrame([], f"no long, ids array<{kind}>, u binary, lo array<double>, hi array<double>"), "blocks")
    slots = F.element_at(F.create_map(*[F.lit(x).cast("int") for c, n in sizes.items() for x in (c, max(1, -(-n // rows)))]), F.col("own"))
    dealt = finite.mapInPandas(own, f"id {kind}, u array<double>, own int").withColumn("slot", F.pmod(F.xxhash64("u"), slots).cast("int"))
    return materialize(dealt.groupBy("own", "slot").applyInPandas(pack, f"no long, ids array<{kind}>, u binary, lo array<double>, hi array<double>"),
                       "blocks")


def _unpacked(batches, pivots, reach: float):
    """(numbers, ids, vectors) of both blocks of every pair of blocks, without the rows that can have no neighbour in the other block."""
    import numpy as np

    def side(batch, at: int, k: int):
        no, ids, u, lo, hi = (batch.column(at + c)[k] for c in range(5))
        ids = ids.values
        return no.as_py(), ids, np.frombuffer(u.as_buffer()).reshape(len(ids), -1), lo.values.to_numpy(), hi.values.to_numpy()

    def near(own, other):
        low, high = other[3] - reach, other[4] + reach
        parted = np.flatnonzero((own[3] < low) | (own[4] > high))  # the pivots that can tell a row of the one from all of the other
        far = _distances(own[2], pivots[parted])
        return np.flatnonzero(((far >= low[parted]) & (far <= high[parted])).all(axis=1))

    for batch in batches:
        for k in range(batch.num_rows):
            a, b = side(batch, 0, k), side(batch, 5, k)
            yield a, near(a, b), b, near(b, a)


def _compared(batches, pivots, threshold: float):
    """(a, b, i, j, similarity): the places of similar rows in two blocks. A pair inside a block comes once."""
    for a, at_a, b, at_b in _unpacked(batches, pivots, _reach(threshold)):
        for i, j, similarity in _near_in_block(a[2][at_a], b[2][at_b], threshold):
            i, j = at_a[i], at_b[j]
            if a[0] == b[0]:
                once = i < j
                i, j, similarity = i[once], j[once], similarity[once]
            if len(i):
                yield a, b, i, j, similarity


def _pairs_of_blocks(batches, pivots, threshold: float, count: bool):
    """Arrow batches of (id_a, id_b, similarity) with id_a < id_b, or with ``count`` of (n). Rows with the same id are no pair."""
    import numpy as np
    import pyarrow as pa

    for a, b, i, j, similarity in _compared(batches, pivots, threshold):
        ia, ib = (x[1].to_numpy(zero_copy_only=False)[at] for x, at in ((a, i), (b, j)))
        less, differ = ia < ib, ia != ib
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([int(differ.sum())], pa.int64())], ["n"])
            continue
        ids = pa.concat_arrays([a[1], b[1]])
        low, high = np.where(less, i, j + len(a[1]))[differ], np.where(less, j + len(a[1]), i)[differ]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(low)), ids.take(pa.array(high)), pa.array(similarity[differ])],
                                         ["id_a", "id_b", "similarity"])


def _links_of_blocks(batches, pivots, threshold: float):
    """Arrow batches of (id_a, id_b): a forest of all the pairs of the task. It holds the ids and a label per row of the blocks that the
    task compares, which are those of two partitions."""
    import numpy as np
    import pyarrow as pa

    first, ids, root, waiting, n = {}, [], np.zeros(0, np.int64), [], 0

    def joined(root):
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        new = root[i] != root[j]
        return _merged(root, i[new], j[new])

    for a, b, i, j, _ in _compared(batches, pivots, threshold):
        for no, members, *_ in (a, b):
            if no not in first:
                first[no] = len(root)
                ids.append(members.take(pa.array(np.arange(len(members)))))  # a copy, which does not keep the batch
                root = np.concatenate([root, np.arange(len(root), len(root) + len(members))])
        waiting.append((i + first[a[0]], j + first[b[0]]))
        n += len(i)
        if n > 1 << 18:  # a pass over the labels for that many links
            root, n = joined(root), 0
    if not ids:
        return
    root, every = joined(root) if waiting else root, pa.concat_arrays(ids)
    own = np.flatnonzero(root != np.arange(len(root)))
    for k in range(0, len(own), 1 << 16):
        part = own[k:k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([every.take(pa.array(root[part])), every.take(pa.array(part))], ["id_a", "id_b"])


def _rep_pairs(reps: DataFrame, threshold: float, n_pivots: int, block: int, give: str = "pairs") -> DataFrame:
    """All pairs (id_a < id_b, similarity) of representatives, each once; with ``give`` = "links" (id_a, id_b) that connect what the pairs
    connect, a forest per task; with "count" their number, as (n) in several rows.

    The stored blocks meet in a plain product of the table with itself: a task reads two partitions of it and takes every two blocks that
    can hold a pair. Nothing is written for that, whatever the number of blocks."""
    kind, pivots, reach = dict(reps.dtypes)["id"], _pivots(reps, n_pivots), _reach(threshold)
    blocks = _blocks(reps, pivots, block)
    centres = reps.sparkSession.sparkContext.broadcast(pivots)
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in ("no", "ids", "u", "lo", "hi")]) for x in "ab")
    meet = F.forall(F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b"),
                    lambda x: (x["lo_a"] - x["hi_b"] <= reach) & (x["lo_b"] - x["hi_a"] <= reach))
    both = a.join(b.hint("shuffle_replicate_nl"), (F.col("no_a") <= F.col("no_b")) & meet)
    if give == "links":
        return both.mapInArrow(lambda batches: _links_of_blocks(batches, centres.value, threshold), f"id_a {kind}, id_b {kind}")
    return both.mapInArrow(lambda batches: _pairs_of_blocks(batches, centres.value, threshold, give == "count"),
                           "n long" if give == "count" else f"id_a {kind}, id_b {kind}, similarity double")


def similar_links(df: DataFrame, threshold: float = SIMILARITY_THRESHOLD, id_col: str = "vec_id",
                  vec_col: str = "embedding", pivots: int = 64, block: int = 2048) -> DataFrame:
    """Links (id_a, id_b) that connect exactly what the pairs of ``similar_pairs`` connect: a forest per task, and each copy of a vector with the smallest id of its copies. The links of a dense group stay in proportion to its rows."""
    members = materialize(collapse_identical(df, id_col, vec_col), "representatives")
    forest = _rep_pairs(_representatives(members, vec_col), threshold, pivots, block, "links")
    stars = members.filter((F.col("id") != F.col("rep")) & (norm(vec_col) > 0)).select(
        F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    both = forest.unionByName(stars).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return both.distinct()


def similar_pairs(df: DataFrame, threshold: float = SIMILARITY_THRESHOLD, id_col: str = "vec_id",
                  vec_col: str = "embedding", pivots: int = 64, block: int = 2048) -> DataFrame:
    """All pairs (id_a < id_b, similarity) with cosine ≥ threshold (V2, J4). Copies of one vector are compared once and
    their pairs written out from the result, so the output holds every pair; use ``similar_links`` where
    connectivity is enough."""
    members = materialize(collapse_identical(df, id_col, vec_col), "representatives")
    pairs = _rep_pairs(_representatives(members, vec_col), threshold, pivots, block)
    copies = members.filter(norm(vec_col) > 0).select("id", "rep")
    several = copies.join(copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "rep").select("id", "rep")
    same = several.select("id", F.col("rep").alias("ra"), F.col("rep").alias("rb"))
    # a vector without copies stands for itself, so the pairs meet the rows that have copies only
    a, b = (several.select(F.col("id").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    x, y = F.coalesce("a", "id_a"), F.coalesce("b", "id_b")
    between = (pairs.join(a, F.col("id_a") == F.col("rep_a"), "left").join(b, F.col("id_b") == F.col("rep_b"), "left")
               .select(F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"), "similarity"))
    x, y = same.alias("x"), same.alias("y")
    within = (x.join(y, (F.col("x.ra") == F.col("y.ra")) & (F.col("x.id") < F.col("y.id")))
              .select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), F.lit(1.0).alias("similarity")))
    return between.unionByName(within)


# ------------------------------------------------------------------------------------------- hashing search
def band_hit_rate(threshold: float, bits: int) -> float:
    """The chance that two vectors at the threshold differ in at most two of a band's sign bits."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi  # a random hyperplane parts them with this chance
    return sum(math.comb(bits, d) * p ** d * (1 - p) ** (bits - d) for d in range(3))


def hash_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a band, bands): bits grow with the logarithm of the rows, so buckets stay small, and there are as many bands as pairs
    at the threshold need to be met with the chance ``recall`` (pairs above it are met more often)."""
    bits = max(8, min(40, math.ceil(math.log2(max(n, 2))) + 4))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(band_hit_rate(threshold, bits), 1 - 1e-9))))


def _signatures(reps: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(id, band, sig): the sign bits of random projections, a band at a time."""
    import numpy as np
    import pandas as pd

    def run(batches):
        planes = None
        for pdf in batches:
            if pdf.empty:
                continue
            u = np.stack(pdf["u"].to_numpy()).astype(np.float64)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(u.shape[1], bands * bits))
            signs = (np.einsum("ij,jk->ik", u, planes) > 0).reshape(len(u), bands, bits)
            sig = (signs << np.arange(bits, dtype=np.int64)).sum(axis=2)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), bands), "band": np.tile(np.arange(bands, dtype=np.int32), len(u)),
                                "sig": sig.ravel()})

    return reps.mapInPandas(run, f"id {dict(reps.dtypes)['id']}, band int, sig long")


def hashed_pairs(df: DataFrame, threshold: float = SIMILARITY_THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                 recall: float = 0.97, seed: int = 7) -> DataFrame:
    """Pairs (id_a < id_b, similarity) of different vectors with cosine ≥ threshold, by hashing (V2 at scale): every returned pair is
    right, and a pair is found with at least the chance ``recall``.

    Every vector has one signature of random sign bits per band. It visits its own bucket and those one bit away (multi-probe), so
    two vectors meet where their signatures differ in at most two bits. Of the buckets where a pair meets one is chosen
    by its two signatures, so a band reports it once. Candidates carry ids only; vectors come back by joins on the id.
    Copies of a vector are one vector here, named by its smallest id (``collapse_identical`` maps the others)."""
    reps = _representatives(materialize(collapse_identical(df, id_col, vec_col), "representatives"), vec_col)
    bits, bands = hash_plan(reps.count(), threshold, recall)
    probes = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << b for b in range(bits))]])
    placed = materialize(_signatures(reps, bits, bands, seed), "signatures").select(
        "id", "band", "sig", F.explode(F.transform(probes, lambda flip: F.col("sig").bitwiseXOR(flip))).alias("bucket"))
    # Spark's estimate for an exploded table is that of the table before; joined by it, all buckets would be sent through the driver
    a, b = placed.hint("merge").alias("a"), placed.alias("b")
    differ = F.col("a.sig").bitwiseXOR(F.col("b.sig"))
    lowest = differ.bitwiseAND(-differ)
    meeting = F.when(F.bit_count(differ) <= 1, F.least("a.sig", "b.sig")).otherwise(F.col("a.sig").bitwiseXOR(lowest))
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id"))
                 & (F.col("a.bucket") == meeting)).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    left, right = (reps.select(F.col("id").alias(name), F.col("u").alias(vector)) for name, vector in (("id_a", "ua"), ("id_b", "ub")))
    return (met.join(left, "id_a").join(right, "id_b").select("id_a", "id_b", dot("ua", "ub").alias("similarity"))
            .filter(F.col("similarity") >= threshold))


def pair_search_stats(df: DataFrame, threshold: float = SIMILARITY_THRESHOLD, id_col: str = "vec_id",
                      vec_col: str = "embedding", pivots: int = 64) -> DataFrame:
    """What the pair search costs at a threshold (one row): different vectors, comparisons (from cell sizes, not by
    making them), pairs found, and the rows of the largest cell."""
    members = materialize(collapse_identical(df, id_col, vec_col), "representatives")
    reps = _representatives(members, vec_col)
    cells = _cells(reps, threshold, pivots).groupBy("cell").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("n"))
    cols = ["vectors", "candidate_pairs", "verified_pairs", "largest_bucket"]

    def part(df_, **vals):
        return df_.select(*[(vals[c] if c in vals else F.lit(None)).cast("long").alias(c) for c in cols])

    parts = (part(reps, vectors=F.lit(1)).unionByName(part(cells, candidate_pairs=F.col("h") * F.col("n"), largest_bucket=F.col("n")))
             .unionByName(part(_rep_pairs(reps, threshold, pivots, 2048, "count"), verified_pairs=F.col("n"))))
    return parts.agg(*[F.coalesce((F.max if c == "largest_bucket" else F.sum)(c), F.lit(0)).alias(c) for c in cols])


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, src: str = "id_a", dst: str = "id_b",
                         max_rounds: int = 100) -> DataFrame:
    """(id, component) with component = smallest id reachable (V3), by star contraction (``graph``). Vertices without
    edges are their own component. Raises if ``max_rounds`` is exceeded (never returns a partial answer)."""
    found = star_components(edges, src, dst, max_rounds)
    own = edges.select(F.col(src).alias("id")).unionByName(edges.select(F.col(dst).alias("id"))) if vertices is None \
        else vertices.select(F.col(vertices.columns[0]).alias("id"))
    if vertices is not None:  # nodes that only links name stay, too
        own = own.unionByName(found.select(F.col("node").alias("id"))).unionByName(found.select(F.col("root").alias("id")))
    return (own.distinct().join(found, F.col("id") == F.col("node"), "left")
            .select("id", F.coalesce("root", "id").alias("component")))


def merge_components(components: DataFrame, items: DataFrame, id_col: str = "vec_id",
                     label_col: str = "label") -> DataFrame:
    """One row per component, single members too: size, first and last member, smallest and largest label and the number of
    different labels (V4). Plain partial aggregates: no list grows with a component."""
    j = components.join(items.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), "id")
    return j.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_members"), F.min("id").alias("first_member"), F.max("id").alias("last_member"),
        F.min("label").alias("min_label"), F.max("label").alias("max_label"), F.count_distinct("label").alias("n_labels"))


# ------------------------------------------------------------------------------------------------ IVF (V5)
def ivf_index(df: DataFrame, lists: int = IVF_LISTS, id_col: str = "vec_id", vec_col: str = "embedding",
              seed: int = 42, max_iter: int = 20):
    """KMeans over unit vectors → (centroids, assignments). Centroids: one row per list (``lists`` rows). The assignments are
    stored partitioned by list, so a search reads only the folders of the lists it probes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    u = df.select(F.col(id_col).alias("id"), unit(F.col(vec_col)).alias("u")).filter(F.col("u").isNotNull())
    feats = u.withColumn("features", array_to_vector("u"))
    k = max(1, lists)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="list").fit(feats)
    path = scratch_path(df.sparkSession, "ivf")
    (model.transform(feats).select("id", "u", "list").repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))
     .write.partitionBy("list").parquet(path))
    assigned = df.sparkSession.read.parquet(path)
    centers = model.clusterCenters()
    cent = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                           "list int, c array<double>")
    return cent, assigned


def ivf_search(centroids: DataFrame, assigned: DataFrame, query: list[float], k: int, probes: int = 10) -> DataFrame:
    """Approximate top-k: nearest ``probes`` lists to the query, exact cosine re-rank inside them."""
    q = _unit_literal(query)
    near = centroids.select("list", dot(unit(F.col("c")), q).alias("s")).orderBy(F.desc("s")).limit(probes)
    cands = assigned.filter(F.col("list").isin([r.list for r in near.collect()]))  # ``probes`` numbers: folders are pruned
    return (cands.select(F.col("id").alias("vec_id"), dot(F.col("u"), q).alias("similarity"))
            .orderBy(F.desc("similarity"), F.asc("vec_id")).limit(k))
