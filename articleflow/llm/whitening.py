"""Whitening of embeddings with eigenvectors refined from single to higher precision.

1. Entries become whole numbers x = floor(scale * entry) + offset. The fit list holds every different x vector once; its size n and the
   sums S per dimension are exact, so n * x - S is exact too, and deviations (n * x - S) / n are rounded once.
2. The covariance V is made in tasks: each sums the products of its centred blocks, and the partial matrices are added by
   Spark per entry. V (dimension squared) is all that the driver sees.
3. ``eigenpairs``: V is scaled by its trace and decomposed in float32. Ogita and Aishima's iteration then corrects the vectors X with
   matrix products in extended precision (numpy's long double, where the machine has more than 64 bits; else double):
   R = I - X'X, S = X'VX, eigenvalues S_ii / (1 - R_ii), correction E_ij = (S_ij + e_j R_ij) / (e_j - e_i), X += X E. It converges
   quadratically where eigenvalues are apart. Those closer than the residual allows form clusters: in a cluster E_ij = R_ij / 2
   (which only restores orthogonality), and V, shifted by the cluster's mean and projected on its vectors, is a small problem of its
   own whose solution turns the vectors; then the iteration goes on with smaller residuals, which part the eigenvalues.
4. Every row is projected on the first components and divided by the root of the eigenvalue.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry, an entry whose x is no long, or a number of entries
other than the table's most frequent one (ties: the larger) are dropped, as are empty vectors. Components whose eigenvalue is zero in
double precision (fewer different vectors than dimensions, constant dimensions) cannot be whitened and are not returned; one vector
alone has none. A deviation beyond a long is null. Repeated rows get equal results but count once in the fit; null ids are carried
along; an empty table gives an empty result. Only the id and vector columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from articleflow.session import materialize

SCALE, OFFSET = 64, 1_000_000
#: Rows of one block in a task (a memory bound only).
ROWS = 4096
WIDE = np.longdouble


# ------------------------------------------------------------------------------------------------- eigenvectors
def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Runs of eigenvalues (indices, by falling value) whose neighbours are at most ``gap`` apart; runs of one are left out."""
    order = np.argsort(values)[::-1]
    cuts = np.flatnonzero(values[order][:-1] - values[order][1:] > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def _step(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, object, object]:
    """One refinement: new vectors, eigenvalues, the gap below which eigenvalues count as clustered, the size of the correction."""
    eye = np.eye(len(v), dtype=x.dtype)
    r = eye - x.T @ x
    s = x.T @ (v @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    gap = 2 * (_norm(off) + _norm(v) * _norm(r))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= gap
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    return x + x @ e, values, gap, _norm(np.where(near, 0, e))


def _norm(m: np.ndarray):
    return np.sqrt((m * m).sum())


def _sub_solve(v: np.ndarray, x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The vectors of a cluster turned to the eigenvectors of V projected on them, shifted so that only differences remain."""
    q = x[:, run]
    small = q.T @ (v @ q)
    shift = np.trace(small) / len(run)
    small = small - shift * (q.T @ q)
    size = _norm(small)
    if size == 0:
        return q
    values, turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))
    return q @ turn[:, np.argsort(values)[::-1]].astype(x.dtype)


def eigenpairs(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    size = float(np.trace(v))
    if not size > 0:
        return np.zeros(len(v)), np.eye(len(v))
    scaled = ((v + v.T) / 2).astype(WIDE) / WIDE(size)
    x = np.linalg.eigh(scaled.astype(np.float32))[1].astype(WIDE)
    limit = np.finfo(WIDE).eps * len(v) * 8
    best = None
    for _ in range(rounds):
        x, values, gap, moved = _step(scaled, x)
        if best is not None and moved >= best and moved < 1e-12:
            break  # as far as the precision goes
        best = moved if best is None else min(best, moved)
        runs = _clusters(values, gap)
        for run in runs:
            x[:, run] = _sub_solve(scaled, x, run)
        if not runs and moved <= limit:
            break
    x = x @ (3 * np.eye(len(v), dtype=WIDE) - x.T @ x) / 2  # orthonormal to the last bits
    values = np.diag(x.T @ (scaled @ x))
    order = np.argsort(values)[::-1]
    return (values[order] * WIDE(size)).astype(np.float64), x[:, order].astype(np.float64)


# ------------------------------------------------------------------------------------------------- the fit
def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE,
                  offset: int = OFFSET) -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    c = F.col(vector_col)
    top = float(1 << 62) / scale
    kept = df.select(F.col(id_col).alias("_id"), F.transform(c, lambda e: e.cast("double")).alias("_v")).filter(
        F.col("_v").isNotNull() & (F.size("_v") > 0)
        & F.forall("_v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(top)), F.lit(False))))
    x = F.transform("_v", lambda e: F.floor(e * F.lit(float(scale))).cast("long") + F.lit(int(offset)))
    return kept.select("_id", x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches, dim: int, at: int = 0):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _matrix(part.column(at), dim)


class Fit:
    """What the tasks need: n, the sums, the unit eigenvectors of the kept components and their eigenvalues."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they fit, else as Python numbers."""
        sums = np.array(self.sums, dtype=object)
        top = max(int(np.abs(x).max(initial=0)), 1)
        if (top + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1) * self.n < 1 << 62:
            return x * np.int64(self.n) - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact; null where they are no long."""
        d = self.exact(x)
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0 ** 62:
            return (d * d).sum(axis=1).tolist()
        sums = [sum(e * e for e in row) for row in d.astype(object).tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def _summed_products(fit_list: DataFrame, dim: int, width: int, centred) -> np.ndarray:
    """The sum of the products of ``centred`` blocks: each task adds up its own, Spark adds the tasks' entries."""
    def run(batches):
        total = None
        for _, x in _blocks(batches, dim):
            block = centred(x)
            total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "p"])

    entries = fit_list.select("x").mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    found = materialize(entries, "whitening-products").toArrow()  # one row per entry of a matrix of the vectors' width
    out = np.zeros((width, width))
    i, j = found.column("i").to_numpy(), found.column("j").to_numpy()
    out[i, j] = out[j, i] = found.column("p").to_numpy()
    return out


def _common_size(rows: DataFrame) -> int | None:
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    return first and first["dim"]


def _sums(fit_list: DataFrame, dim: int) -> list[int]:
    """The sums per dimension, in decimals that hold any sum of longs."""
    rows = (fit_list.select(F.posexplode("x").alias("d", "v")).groupBy("d")
            .agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect())  # one row per dimension
    by = {r["d"]: int(r["s"]) for r in rows}
    return [by[d] for d in range(dim)]


def fit(fit_list: DataFrame, dim: int, components: int) -> Fit:
    """The fit over a stored table of different vectors (x)."""
    n = fit_list.count()
    made = Fit(n, _sums(fit_list, dim), np.ones(0), np.zeros((dim, 0)), 0.0)
    v = _summed_products(fit_list, dim, dim, made.centred) / n
    values, vectors = eigenpairs(v)
    kept = min(components, int((values > max(values[0], 0) * dim * np.finfo(np.float64).eps).sum()))
    made.values, made.vectors, made.trace = values[:kept], vectors[:, :kept], float(np.trace(v))
    return made


def _means(fit_list: DataFrame, dim: int, made: Fit) -> np.ndarray:
    width = len(made.values)

    def run(batches):
        total = np.zeros(width)
        for _, x in _blocks(batches, dim):
            total += made.whitened(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["i", "s"])

    rows: list[Row] = fit_list.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width)
    for row in rows:  # one per component
        out[row["i"]] = row["s"]
    return out / made.n


def identity_error(fit_list: DataFrame, dim: int, made: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, centred before multiplying."""
    mean, width = _means(fit_list, dim, made), len(made.values)
    cov = _summed_products(fit_list, dim, width, lambda x: made.whitened(x) - mean) / made.n
    return float(np.abs(cov - np.eye(width)).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """Per remaining row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = materialize(whole_vectors(df, id_col, vector_col, scale, offset), "whitening-rows")
    kind = dict(df.select(id_col).dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {RESULT}"
    dim = _common_size(rows)
    if dim is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == dim)
    fit_list = materialize(rows.select("x").distinct(), "whitening-fit")
    made = fit(fit_list, dim, components)
    width = len(made.values)
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(fit_list, dim, made)
    explained = made.values / made.trace

    def run(batches):
        for part, x in _blocks(batches, dim, 1):
            m = part.num_rows
            each = np.repeat(np.arange(m), width)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1), m), pa.int32()),
                pa.array(np.full(m * width, made.n), pa.int64()), pa.array(made.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(made.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("_id").alias(id_col), "x").mapInArrow(run, schema)
