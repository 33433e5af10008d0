"""Whitening of embeddings: exact distributed covariance, float32 eigenvectors refined in higher precision.

Entries become whole numbers on a fixed grid, so counts, sums and products are exact whatever the order of the rows.
Three passes over the vectors gather sums, products of centred entries, and the projections; what reaches the driver is
bounded by the square of the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import in_tasks, settle

#: Numbers are cut into digits of so many bits; products of digits of up to ``ROWS`` rows are exact in a double.
DIGIT, ROWS = 20, 1 << 12
#: Entries must stay below this on the grid.
LIMIT = 1 << 53
_SUM = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """``basis`` has one component a column, by falling eigenvalue; sums and centre are on the grid."""

    n: int
    sums: tuple[int, ...]
    centre: tuple[int, ...]
    farthest: int
    values: np.ndarray
    basis: np.ndarray
    trace: float


def _settled(change: np.ndarray, kind: type) -> bool:
    return bool(np.abs(change).max(initial=0) <= 64 * np.finfo(kind).eps * max(1, len(change)))


def _refine(matrix: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One step by matrix products: (eigenvalues, better vectors, the change in their own basis, width of a cluster).

    The change is half of what lacks to orthogonality plus a part that is exactly antisymmetric, so rounding within a cluster only turns it.
    """
    gap = np.eye(len(matrix), dtype=x.dtype) - x.T @ x
    inner = x.T @ (matrix @ x)
    gap, inner = (gap + gap.T) / 2, (inner + inner.T) / 2
    values = np.diag(inner) / (1 - np.diag(gap))
    width = 2 * (np.linalg.norm((inner - np.diag(values)).astype(float)) + np.linalg.norm(matrix.astype(float)) * np.linalg.norm(gap.astype(float)))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= width
    change = gap / 2 + np.where(near, 0, (inner + (values[None, :] + values[:, None]) / 2 * gap) / np.where(near, 1, apart))
    return values, x + x @ change, change, float(width)


def _orthogonal(x: np.ndarray) -> np.ndarray:
    """Nearly orthogonal columns made orthogonal: what lacks is squared."""
    return x @ (1.5 * np.eye(x.shape[1], dtype=x.dtype) - x.T @ x / 2)


def _part_clusters(matrix: np.ndarray, x: np.ndarray, values: np.ndarray, width: float) -> np.ndarray:
    """Vectors of eigenvalues that stand within ``width`` of a neighbour are turned by the eigenvectors of their own small matrix, less its mean eigenvalue."""
    order = np.argsort(values)
    ends = np.flatnonzero(np.diff(values[order]) > width) + 1
    for group in np.split(order, ends):
        if len(group) > 1:
            own = x[:, group]
            shifted = matrix @ own - own * values[group].mean()
            small = own.T @ shifted
            size = np.abs(small).max()
            if size > 0:
                turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(x.dtype)
                x[:, group] = own @ _orthogonal(turn)
    return x


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, vectors as columns) of a symmetric matrix of long doubles.

    Starts from float32 vectors and corrects them by Ogita-Aishima steps, in doubles until these can do no better, then
    in long doubles. Clusters of eigenvalues are parted by sub-solves after each step; of equal eigenvalues any basis of
    their space is right. Each vector's largest entry is positive.
    """
    size = np.abs(matrix).max(initial=0)
    if not len(matrix) or size == 0:
        return np.zeros(len(matrix), np.longdouble), np.eye(len(matrix), dtype=np.longdouble)
    scaled = (matrix / size).astype(np.longdouble)
    x = np.linalg.eigh(scaled.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        own, x = scaled.astype(kind), x.astype(kind)
        for _ in range(12):
            values, x, change, width = _refine(own, x)
            if _settled(change, kind):
                break
            x = _part_clusters(own, x, values, width)
    x = _orthogonal(_orthogonal(x))
    values = (x * (scaled @ x)).sum(axis=0)
    order = np.argsort(-values)
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x *= np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])
    return values[order] * size, x


def _grid(column: pa.Array, scale: int, offset: int) -> np.ndarray:
    """Rows of whole numbers; all lists have the same length and sound entries."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return (np.floor(flat * scale).astype(np.int64) + offset).reshape(len(column), -1)


def _digits(rows: np.ndarray, farthest: int) -> list[np.ndarray]:
    """The numbers' digits to the base 2**DIGIT, signed like the numbers."""
    sign, left, out = np.sign(rows), np.abs(rows), []
    for _ in range(max(1, -(-farthest.bit_length() // DIGIT))):
        out.append((sign * (left & ((1 << DIGIT) - 1))).astype(np.float64))
        left >>= DIGIT
    return out


def _usable(vector_col: str, scale: int) -> Column:
    sound = F.forall(F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(LIMIT // scale)))
    return F.col(vector_col).isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(vector_col) > 0)


def _sums(rows: DataFrame, scale: int, offset: int) -> list:
    """(i, n, total, low, high) of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals, low, high = 0, None, None, None
        for batch in batches:
            if batch.num_rows:
                x = _grid(batch.column(0), scale, offset)
                own = [(int(h) << 26) + int(l) for h, l in zip((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0), strict=True)]
                totals = own if totals is None else [a + b for a, b in zip(totals, own, strict=True)]
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
                n += len(x)
        if n:
            d = len(totals)
            columns = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in totals], _SUM), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "total", "low", "high"])

    parts = rows.transform(in_tasks, run, "i int, n long, total decimal(38,0), low long, high long")
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()  # a row a dimension


def _products(rows: DataFrame, centre: tuple[int, ...], farthest: int, scale: int, offset: int) -> np.ndarray:
    """Exact sums of products of centred entries, as Python numbers; one row a task and pair of dimensions is summed by Spark."""
    d = len(centre)
    middle, upper = np.array(centre, np.int64), np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            x = _grid(batch.column(0), scale, offset) - middle if batch.num_rows else np.zeros((0, d), np.int64)
            for at in range(0, len(x), ROWS):
                digits = _digits(x[at : at + ROWS], farthest)
                for p, a in enumerate(digits):
                    for q, b in enumerate(digits):
                        total = total + ((a.T @ b).astype(np.int64).astype(object) << (DIGIT * (p + q)))
        columns = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array([Decimal(int(v)) for v in total[upper]], _SUM)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "total"])

    parts = rows.transform(in_tasks, run, "i int, j int, total decimal(38,0)")
    out = np.zeros((d, d), object)
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # a row a pair of dimensions
        out[r.i, r.j] = out[r.j, r.i] = int(r.total)
    return out


def _quotient(value: int, by: int) -> np.longdouble:
    """value / by to the precision of a long double."""
    high, rest = divmod(value, by)
    lead = float(high)
    return np.longdouble(lead) + np.longdouble(float(high - int(lead))) + np.longdouble(float((rest << 64) // by)) / np.longdouble(float(1 << 64))


def fit(rows: DataFrame, *, scale: int = 1024, offset: int = 100_000) -> Whitening | None:
    """Whitening of the vectors in the only column of ``rows``, which are sound and of one length; None without rows.

    With x = floor(scale * entry) + offset, the covariance of x has divisor n. x is centred on the whole number next to its
    mean before it is multiplied, and what that leaves is taken off exactly.
    """
    found = _sums(rows, scale, offset)
    if not found:
        return None
    n, sums = found[0].n, tuple(int(r.total) for r in found)
    centre = tuple((2 * s + n) // (2 * n) for s in sums)
    farthest = max(max(abs(r.low - c), abs(r.high - c)) for r, c in zip(found, centre, strict=True))
    products, rest = _products(rows, centre, farthest, scale, offset), [s - n * c for s, c in zip(sums, centre, strict=True)]
    d = len(sums)
    covariance = np.array([[_quotient(n * products[i, j] - rest[i] * rest[j], n * n) for j in range(d)] for i in range(d)], np.longdouble)
    values, basis = eigenvectors(covariance)
    return Whitening(n, sums, centre, farthest, values.astype(np.float64), basis.astype(np.float64), float(np.trace(covariance)))


def project(rows: DataFrame, model: Whitening, *, components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(vec_id, deviation, whitened array) of rows (vec_id, vector)."""
    k = min(components, len(model.sums))
    centre = np.array(model.centre, np.int64)
    rest = np.array([s - model.n * c for s, c in zip(model.sums, model.centre, strict=True)], object)
    weights = np.zeros((len(centre), k))
    for j in range(k):
        if model.values[j] > np.finfo(float).eps * len(centre) * model.values[0]:  # else no vector deviates that way
            weights[:, j] = model.basis[:, j] / np.sqrt(model.values[j])
    shift, n = np.array([r / model.n for r in rest]), model.n
    small = len(centre) * (n * (model.farthest + 1)) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _grid(batch.column(1), scale, offset) - centre
            off = y * n - rest.astype(np.int64) if small else y.astype(object) * n - rest
            far = [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]
            z = (y - shift) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) * k + 1, k, dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return rows.transform(in_tasks, run, "vec_id long, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity."""
    z = [F.col("whitened")[k] for k in range(components)]
    entries = [F.abs(F.covar_pop(z[i], z[j]) - F.lit(float(i == j))) for i in range(components) for j in range(i, components)]
    found = projected.agg(*[e.alias(f"e{k}") for k, e in enumerate(entries)]).first()
    return float(max(found))


def whiten(vectors: DataFrame, *, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and leading component.

    Vectors that are null or empty, or hold an entry that is null, no finite number or beyond 2**53 / scale, give no rows,
    nor do those of another length than the most frequent one (the greatest of equally frequent ones). A deviation that
    no long can hold is null. Along a component without variance, to a double's precision beside the first, ``whitened`` is 0, which the identity error shows.
    Repeated rows count each time, null ids are kept, ties of eigenvalues may fall in either order; an empty table gives
    no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(_usable("vector", scale))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    model = None
    if common:
        rows = rows.where(F.size("vector") == common.d)
        model = fit(rows.select("vector"), scale=scale, offset=offset)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = min(components, common.d)
    projected = settle(project(rows, model, components=k, scale=scale, offset=offset), "whitened")
    share = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else 0.0) for v in model.values[:k]])
    long = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(identity_error(projected, k)).alias("identity_error"),
    )
