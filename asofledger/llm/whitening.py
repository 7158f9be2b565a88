"""Whitening of embeddings by their leading principal components, found by spectrum slicing.

Method. Entries become integers, floor(SCALE * c). The fit list is each distinct vector once; its count and sums are exact integers, and its covariance is summed in a second pass, by task, from centred vectors. One matrix as
wide as a vector goes to the driver, however many rows there are. There the spectrum is sliced: the signs of D in the LDL^T of the shifted covariance (in its tridiagonal form, which has the same inertia and needs no pivoting) count the eigenvalues above a shift, and
bisection by these counts isolates each leading eigenvalue. Rayleigh quotient iteration, begun from inverse iterations at the isolated shift, converges cubically to its vector, and counts on both sides of the value that it reached certify
its number; one that left its slice is begun anew in a narrower one. Eigenvalues that no shift can tell apart have vectors that are kept orthogonal to each other.
The whitened fit list's own covariance is summed in a last pass, for its distance from the identity.

Cases. Rows whose vector is null or holds a null, NaN or infinity are dropped. Rows of another length than the commonest among distinct vectors (the smaller of equals) have no components, and so no rows. Components whose eigenvalue is below RANK of the trace
are left out, as a double can't tell it from zero: one distinct vector, or empty tables, give no rows. Repeated rows get the same rows each. Entries beyond the range of a long are its ends. Kept columns with the name of a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, release

SCALE, COMPONENTS, RANK = 256, 4, 1e-11
EPS = np.finfo(np.float64).eps
FIELDS = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = np.array(matrix, dtype=np.float64)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size:
            v /= size
            own = a[k + 1 :, k + 1 :]
            p = own @ v
            w = p - (v @ p) * v
            own -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than a shift: positive entries of D in the LDL^T of the shifted matrix."""
    tiny = EPS * EPS * max(1e-300, float(np.abs(diagonal).max(initial=0)) + float(np.abs(off).max(initial=0)))
    count, pivot = 0, 0.0
    for i, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = pivot if abs(pivot) > tiny else -tiny
        count += pivot > 0
    return count


def _nearest(matrix: np.ndarray, found: list[np.ndarray], start: np.ndarray, shift: float, unit: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from inverse iterations at a shift, orthogonal to the vectors found."""
    held = np.array(found).T if found else np.zeros((len(matrix), 0))
    clear = lambda v: v - held @ (held.T @ v)
    v, best, rho = clear(start), None, shift
    for turn in range(40):
        v /= np.linalg.norm(v)
        if turn >= 2:
            rho = float(v @ matrix @ v)
            residual = float(np.linalg.norm(matrix @ v - rho * v))
            if best is not None and residual >= best[0] / 2:
                return (best[1], best[2]) if best[0] <= residual else (rho, v)
            best = (residual, rho, v)
        try:
            after = np.linalg.solve(matrix - rho * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            after = np.linalg.solve(matrix - (rho + 2 * unit) * np.eye(len(matrix)), v)
        v = clear(clear(after / np.abs(after).max()))
    return best[1], best[2]


def leading(matrix: np.ndarray, most: int = COMPONENTS, rank: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues in falling order, and their unit vectors as columns; those below `rank` of the trace are left out."""
    diagonal, off = tridiagonal(matrix)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off)) if len(diagonal) else np.zeros(0)
    size = float((np.abs(diagonal) + reach).max(initial=0.0))
    unit = EPS * size * max(1, len(diagonal)) ** 0.5
    least, values, vectors = rank * float(np.trace(matrix)), [], []
    rng = np.random.default_rng(0)
    for i in range(1, min(most, len(diagonal)) + 1):
        low, high = -size - 4 * unit, size + 4 * unit  # at least i eigenvalues are above low, fewer than i above high
        if size == 0 or above(diagonal, off, least) < i:
            break

        def halve() -> bool:
            nonlocal low, high
            middle = (low + high) / 2
            if not low < middle < high or high - low <= 2 * unit:
                return False
            if above(diagonal, off, middle) >= i:
                low = middle
            else:
                high = middle
            return True

        while above(diagonal, off, low) - above(diagonal, off, high) > 1 and halve():
            pass
        alone = above(diagonal, off, low) - above(diagonal, off, high) == 1
        while True:
            value, vector = _nearest(matrix, [] if alone else vectors, rng.standard_normal(len(matrix)), (low + high) / 2, unit)
            if above(diagonal, off, value + 64 * unit) < i <= above(diagonal, off, value - 64 * unit):
                break
            if not halve():
                raise ArithmeticError(f"eigenvalue {i} could not be certified")
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).T if vectors else np.zeros((len(diagonal), 0))


def integer_rows(df: DataFrame, vector_col: str, out: str) -> DataFrame:
    """df's rows with a finite vector, and it as an array of longs."""
    entry = lambda c: c.cast("double")
    bad = F.exists(f"`{vector_col}`", lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf")))
    return df.where(F.col(f"`{vector_col}`").isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn(out, F.transform(f"`{vector_col}`", lambda c: F.floor(entry(c) * SCALE)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _pass(rows: DataFrame, width: int, step, kind: str) -> list:
    """step sums a matrix of a batch's vectors into a flat list; the sums of all tasks, added up by Spark: as many numbers as the list has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = step(_matrix(batch.column(0), width))
                total = made if total is None else [a + b for a, b in zip(total, made)] if isinstance(made, list) else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0)) if isinstance(total, list) else pa.array(total)], names=["k", "v"])
        release()

    made = rows.mapInArrow(run, f"k long, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return [v for _, v in sorted(map(tuple, made))]


def _exact(n_rows: int, largest: int) -> bool:
    """Whether sums of so many integers of that size fit a long."""
    return n_rows * largest < 1 << 62


def _sums(x: np.ndarray) -> list[int]:
    fits = _exact(len(x), max(abs(int(x.min())), abs(int(x.max()))))
    return [len(x), *map(int, x.sum(axis=0, dtype=np.int64) if fits else x.astype(object).sum(axis=0))]


@dataclass
class Fit:
    """What whitening needs: the fit list's count and sums, its components, and the measured error."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n * x - S)^2: in longs where they fit, else in integers of Python."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums))
        if len(self.sums) * most * most < 1 << 62:
            return pa.array(((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        wide = ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return pa.array([Decimal(v) for v in wide], pa.decimal128(38, 0))


def fit(rows: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """The components of the distinct vectors of rows (x array<long>) of the commonest length; None if there are none."""
    distinct = materialize(rows.select("x").distinct(), "fit")
    width = distinct.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None or not width["w"]:
        return None
    d = width["w"]
    own = distinct.where(F.size("x") == d)
    n, *sums = [int(v) for v in _pass(own, d, _sums, "decimal(38,0)")]
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float64) - mean
        return (y.T @ y)[upper]

    matrix = np.zeros((d, d))
    matrix[upper] = np.array(_pass(own, d, products, "double")) / n
    matrix = np.triu(matrix) + np.triu(matrix, 1).T
    values, vectors = leading(matrix, most)
    made = Fit(n, sums, mean, values, vectors, float(np.trace(matrix)))
    if len(values):
        k = len(values)
        centre = np.array(_pass(own, d, lambda x: made.whiten(x).sum(axis=0), "double")) / n

        def again(x: np.ndarray) -> np.ndarray:
            y = made.whiten(x) - centre
            return (y.T @ y).ravel()

        made.identity_error = float(np.abs(np.array(_pass(own, d, again, "double")).reshape(k, k) / n - np.eye(k)).max())
    return made


def whiten(df: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None, most: int = COMPONENTS) -> DataFrame:
    """The columns keep (all but the vector) of each row with a finite vector, and FIELDS, once per component."""
    new = {n for n, _ in FIELDS}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in new and c.lower() != vector_col.lower()]
    inner = free_name(df, "__x")
    given = integer_rows(df, vector_col, inner)
    found = fit(given.select(F.col(inner).alias("x")), most)
    given = given.select(*[F.col(f"`{c}`") for c in kept], inner)
    schema = T.StructType([*given.select(*[f"`{c}`" for c in kept]).schema.fields, *[T.StructField(n, t) for n, t in FIELDS]])
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], schema)
    width, k = len(found.sums), len(found.values)
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(len(kept)), width)
            r = len(x)
            each = pa.array(np.repeat(np.arange(r), k))
            made = [np.tile(np.arange(1, k + 1, dtype=np.int32), r), np.full(r * k, found.n), found.deviation(x).take(each), found.whiten(x).ravel(), np.tile(explained, r), np.full(r * k, found.identity_error)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(each) for i in range(len(kept))], *[a if isinstance(a, pa.Array) else pa.array(a) for a in made]], names=[*kept, *[n for n, _ in FIELDS]])
        release()

    return given.where(F.size(inner) == width).mapInArrow(run, schema)
