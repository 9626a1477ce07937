"""Embedding whitening with components from spectral divide and conquer.

The covariance is a sum that Spark takes over partitions; its size is that of one vector squared, whatever the
table's size. A polar decomposition of the shifted covariance, by QDWH's QR iteration, tells the eigenvectors above the
shift from those below; each invariant subspace is split again, until it is a component. The whitening matrix is
broadcast and every row is projected on it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import fresh, in_arrow, staged_table

#: Rows of a partial covariance that meet in one task, of as many as a vector has entries.
STRIPES = 16
EPS = float(np.finfo(float).eps)
GROUPED = 100  # vectors multiplied at once are this many times their length


# --- spectral divide and conquer (matrices of one vector's length squared) ---------------------

def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its matrix sign.

    QDWH: X' = (b/c) X + (a - b/c)/sqrt(c) Q1 Q2', where [sqrt(c) X; 1] = [Q1; Q2] R, with weights from a lower
    bound of the singular values. At most six steps bring any nonsingular matrix to its limit.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low, one = EPS / n, np.eye(n)
    for _ in range(30):
        square = low * low
        g = (4 * (1 - square) / square ** 2) ** (1 / 3)
        root = np.sqrt(1 + g)
        wa = root + np.sqrt(8 - 4 * g + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0 - EPS)
        if moved <= 100 * EPS * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span what lies above a shift, and their number; None for a multiple of one."""
    n = len(a)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n))
    if spread <= 4 * EPS * scale:
        return None
    middle = float(np.median(np.diag(a)))
    mean = float(np.trace(a) / n)  # lies strictly between the outer eigenvalues
    best = None
    for shift in (middle, mean, mean + spread / (7 * n), mean - spread / (11 * n), mean + spread / (90 * n)):
        sign = polar_sign(a - shift * np.eye(n)) if np.any(a - shift * np.eye(n)) else np.zeros_like(a)
        upper = (sign + np.eye(n)) / 2
        k = int(round(float(np.trace(upper))))
        if not 0 < k < n:
            continue
        # Columns of the projector span the subspace; two steps of orthogonal iteration make the basis exact.
        order = np.argsort(-np.einsum("ij,ij->j", upper, upper), kind="stable")
        q, _ = np.linalg.qr(upper[:, order[:k]])
        q, _ = np.linalg.qr(upper @ q)
        q, _ = np.linalg.qr(upper @ q)
        full, _ = np.linalg.qr(np.hstack([q, (np.eye(n) - upper)[:, order[::-1][:n - k]]]))
        rest, _ = np.linalg.qr(((np.eye(n) - upper) @ full[:, k:]))
        basis = np.hstack([q, rest])
        basis, _ = np.linalg.qr(basis)
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = (left, basis, k)
        if left <= 50 * EPS * scale:
            break
    return best and (best[1], best[2])


def spectral_components(cov: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the ``wanted`` largest.

    A subspace is split while it holds a wanted component and isn't a multiple of the identity.
    """
    scale = float(np.linalg.norm(cov))
    found: list[tuple[float, np.ndarray]] = []

    def divide(basis: np.ndarray) -> None:
        if len(found) >= wanted or not basis.shape[1]:
            return
        part = basis.T @ cov @ basis
        part = (part + part.T) / 2
        cut = _split(part, scale) if len(part) > 1 else None
        if cut is None:
            found.extend((float(v @ cov @ v), v) for v in basis.T)
            return
        inner, k = cut
        divide(basis @ inner[:, :k])
        divide(basis @ inner[:, k:])

    divide(np.eye(len(cov)))
    found.sort(key=lambda x: -x[0])
    found = found[:wanted]
    return np.array([e for e, _ in found]), np.array([v for _, v in found]).reshape(len(found), len(cov)).T


# --- Spark -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` vectors fitted, their per-entry sums, components (columns), eigenvalues and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def steps(vector: Column) -> Column:
    """Each entry as a whole number of 1/256; null if the vector is null or an entry is null, NaN or infinite."""
    real = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(real, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(real, lambda c: F.floor(c * 256)))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _sums(vectors: DataFrame, d: int) -> np.ndarray:
    """Exact per-entry sums: one row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, any_row = np.zeros(d, np.int64), False
        for batch in batches:
            if batch.num_rows:
                total, any_row = total + _matrix(batch, "x").sum(0), True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], names=["at", "total"])

    rows = in_arrow(vectors, run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(d, np.int64)
    for r in rows:
        out[r["at"]] = r["total"]
    return out


def _covariance(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Centred before it is multiplied. Each task adds up its vectors; the tasks' rows are added by stripes of rows."""
    d, mean = len(sums), sums / n

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, any_row = np.zeros((d, d)), False
        for batch in batches:
            for a in range(0, batch.num_rows, GROUPED * d):
                x = _matrix(batch.slice(a, GROUPED * d), "x") - mean
                total, any_row = total + x.T @ x, True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column("at").to_pylist(), batch.column("part")):
                total[at] = total.get(at, 0) + part.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["at", "part"])

    parts = in_arrow(vectors, partial, "at int, part array<double>").repartition(min(STRIPES, d), "at")
    out = np.zeros((d, d))
    for r in in_arrow(parts, added, "at int, part array<double>").collect():
        out[r["at"]] = r["part"]
    return (out + out.T) / (2 * n)


def _fitted(vectors: DataFrame, components: int) -> Whitening | None:
    """From distinct vectors ``x`` (a written table); None without any, or if they have no entries."""
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("most")).first()
    if not shape["n"] or not shape["most"]:
        return None
    if shape["d"] != shape["most"]:
        raise ValueError(f"vectors have between {shape['d']} and {shape['most']} entries; one length is needed")
    sums = _sums(vectors, shape["d"])
    cov = _covariance(vectors, shape["n"], sums)
    values, columns = spectral_components(cov, min(components, shape["d"]))
    trace = float(np.trace(cov))
    real = values > max(trace, 0.0) * EPS * max(shape["d"], 1)
    return Whitening(shape["n"], sums, columns[:, real], values[real], trace)


def fit(docs: DataFrame, vector: str = "embedding", components: int = 4) -> tuple[Whitening | None, DataFrame]:
    """A whitening fitted on every distinct vector, and those vectors (column ``x``, a written table).

    Rows whose vector is null or has a null or non-finite entry are left out. Copies are dropped where they
    stand before they are shuffled, so a very frequent vector is one row a task.
    """
    vectors = staged_table(docs.select(steps(F.col(vector)).alias("x")).where("x is not null").distinct(), "whitening-vectors")
    return _fitted(vectors, components), vectors


def project(docs: DataFrame, model: Whitening | None, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """``docs`` with ``whitened`` (one double a component) and ``deviation``, the exact sum of ``(n*x-S)^2``.

    Rows whose vector can't be fitted are dropped, and so are all rows where the model is None. Components of
    variance zero have no scale; the model has none of them. A deviation that no long holds is an error. The other
    columns pass through; a column named like an added one is replaced.
    """
    x = fresh(docs, "_steps")
    kept = [c for c in docs.columns if c not in (whitened, deviation)]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), steps(F.col(vector)).alias(x)).where(F.col(x).isNotNull())
    schema = rows.drop(x).withColumns({whitened: F.lit(None).cast("array<double>"), deviation: F.lit(None).cast("long")}).schema
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    sent = docs.sparkSession.sparkContext.broadcast((model.n, model.sums, model.sums / model.n, model.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n, sums, mean, matrix = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch, x)
            if v.shape[1] != len(sums):
                raise ValueError(f"a vector has {v.shape[1]} entries, the model {len(sums)}")
            far = max(n * float(np.abs(v).max(initial=0)) + float(np.abs(sums).max(initial=0)), 1.0)
            if far < 2.0 ** 62 and far * far * max(len(sums), 1) < 2.0 ** 62:
                apart = ((n * v - sums) ** 2).sum(1).tolist()
            else:
                apart = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in v]
            white = (v - mean) @ matrix
            arrays = [batch.column(c) for c in kept] + [pa.array(list(white), pa.list_(pa.float64())), pa.array(apart, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return in_arrow(rows, run, schema)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, taken over the fit list."""
    k, sent = model.vectors.shape[1], vectors.sparkSession.sparkContext.broadcast((model.sums / model.n, model.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        mean, matrix = sent.value
        for batch in batches:
            if batch.num_rows:
                white = (_matrix(batch, "x") - mean) @ matrix
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in white.T], names=[f"w{i}" for i in range(k)])

    white = in_arrow(vectors, run, ", ".join(f"w{i} double" for i in range(k)))
    pairs = {f"c{i}_{j}": (i, j) for i in range(k) for j in range(i + 1)}
    got = white.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(c) for c, (i, j) in pairs.items())).first()
    return max(abs(got[c] - (i == j)) for c, (i, j) in pairs.items())


def whitened_components(docs: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each fitted row and component.

    Fewer components come out where the covariance has a lower rank: none for one distinct vector. Repeated rows
    and ids each have their rows; a null id passes through. An empty table gives an empty result, and vectors of
    different lengths are an error.
    """
    model, vectors = fit(docs, vector, components)
    rows = project(docs.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), model, "vector")
    known = model is not None and model.vectors.shape[1] > 0
    shares = [float(e / model.trace) for e in model.values] if known else []
    error = identity_error(vectors, model) if known else None
    one = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if known else 0).cast("long").alias("n"), "deviation", "whitened",
                      F.get(F.array(*(F.lit(s) for s in shares)).cast("array<double>"), F.col("at")).alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))
