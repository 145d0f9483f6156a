"""Whitening of embeddings by the polarisation covariance.

An entry c becomes the integer x = floor(64 * c) + 1,000,000.  The fit list is each distinct vector x once, with n vectors and the
sum S of each dimension.  Every variance is exact: the tasks square the centred integers of each dimension and of the sum of
each pair of dimensions, and differences of these variances give all cross-covariances,

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2,

which are divided only at the end, as fractions, and assembled for ``eigh``.  Tasks centre on the integer c next below the mean
before they multiply: with y = x - c and s = S - n * c, the sum of (n * x - S)**2 is n**2 * sum(y**2) - n * s**2.

Vectors travel as bytes of the narrowest width that holds them, so the shuffle that finds distinct vectors is about a fourth of the
input, and copies of one vector are combined before it.  What a task sends is one row for each pair of dimensions.  The driver
holds one matrix of dimensions by dimensions.

Defined cases: vectors that are NULL or hold a NULL or non-finite entry are dropped; among the rest the length that most
distinct vectors have is used (of equally frequent ones the longest) and others are dropped; empty vectors are dropped;
repeated vec_ids get a row each and a NULL vec_id stays NULL; an entry beyond 2**52 after scaling counts as 2**52; a
deviation beyond 64 bits is NULL; where the variance along a component is zero (fewer distinct vectors than components) ``whitened``
is NULL and the component counts neither in ``identity_error`` nor in a division; without variance ``explained`` is NULL; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LARGEST = 2.0 ** 52
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
#: Components with less than this share of the largest eigenvalue have no variance that doubles can tell from none.
RANK_TOLERANCE = 1e-13
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(x: np.ndarray) -> list[bytes]:
    """The rows of x - OFFSET, each in the narrowest width that holds it behind a byte that tells which. Equal vectors, and
    no others, have equal bytes."""
    y = x - OFFSET
    low, high = y.min(1), y.max(1)
    kind = sum((low < np.iinfo(t).min) | (high > np.iinfo(t).max) for t in WIDTHS[:3]) + np.zeros(len(y), np.int64)
    out = [b""] * len(y)
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        for i, row in zip(own.tolist(), y[own].astype(WIDTHS[k])):
            out[i] = bytes([k]) + row.tobytes()
    return out


def stacked(column, size: int) -> np.ndarray:
    """Packed vectors of one size as the rows of a matrix."""
    rows = column.to_pylist()
    out = np.empty((len(rows), size), np.int64)
    kinds = np.array([v[0] for v in rows], np.int64)
    for k in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == k)
        flat = np.frombuffer(b"".join([rows[i] for i in own.tolist()]), np.uint8).reshape(len(own), -1)
        out[own] = np.ascontiguousarray(flat[:, 1:]).view(WIDTHS[k])
    return out + OFFSET


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, size, x) of the rows with a usable vector."""
    ddl = "vec_id long, size int, x binary"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts, entries = np.cumsum(sizes) - sizes, column.flatten().to_numpy(zero_copy_only=False)  # NULL becomes NaN
            for size in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == size)
                c = entries[starts[own][:, None] + np.arange(size)]
                fine = np.isfinite(c).all(1)
                if fine.any():
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(SCALE * c[fine]), -LARGEST, LARGEST).astype(np.int64) + OFFSET
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own[fine])), pa.array(
                        np.full(len(x), size, np.int32)), pa.array(packed(x), pa.binary())], schema=arrow_schema(ddl))

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, ddl)


def exact_sums(matrix: np.ndarray, room: int = 2 ** 62) -> list[int]:
    """Sums of the columns as Python integers, in 64 bits where they fit."""
    if not len(matrix):
        return [0] * matrix.shape[1]
    top = int(np.abs(matrix).max()) if matrix.dtype != object else None
    if top is not None and top * len(matrix) < room:
        return matrix.sum(0).tolist()
    return [int(v) for v in matrix.astype(object).sum(0)]


def squares(y: np.ndarray) -> np.ndarray:
    """y**2 element by element, exactly."""
    return y * y if int(np.abs(y).max(initial=0)) < 2 ** 31 else y.astype(object) ** 2


def totals(fit: DataFrame) -> tuple[int, int, list[int]]:
    """(size, n, S) of the length that most distinct vectors have; (0, 0, []) without any."""
    chosen = fit.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).head()
    if chosen is None:
        return 0, 0, []
    size = chosen["size"]

    def run(batches):
        sums = [0] * size
        for b in batches:
            for i, s in enumerate(exact_sums(stacked(b.column(0), size))):
                sums[i] += s
        yield from batches_of(((i, str(s)) for i, s in enumerate(sums)), arrow_schema("i int, s string"))

    rows = fit.filter(F.col("size") == size).select("x").mapInArrow(run, "i int, s string")
    got = rows.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    sums = [0] * size
    for r in got:
        sums[r.i] = int(r.s)
    return size, chosen["count"], sums


def covariance(fit: DataFrame, size: int, n: int, sums: list[int]) -> tuple[list[list[Fraction]], np.ndarray]:
    """(V as fractions, V as doubles) of the fit list of vectors of one length."""
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s - n * c for s, c in zip(sums, centre.tolist())]
    ddl = "i int, j int, q string"

    def run(batches):
        found = [[0] * (size - i) for i in range(size)]
        for b in batches:
            y = stacked(b.column(0), size) - centre
            for i in range(size):
                # The dimension itself, then its sums with all dimensions behind it: squared after centring.
                both = np.concatenate([y[:, i:i + 1], y[:, i:i + 1] + y[:, i + 1:]], axis=1)
                for j, q in enumerate(exact_sums(squares(both))):
                    found[i][j] += q
        yield from batches_of(((i, i + j, str(q)) for i, row in enumerate(found) for j, q in enumerate(row)), arrow_schema(ddl))

    rows = fit.filter(F.col("size") == size).select("x").mapInArrow(run, ddl)
    got = rows.groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect()  # a row for each pair
    square = {(r.i, r.j): int(r.q) for r in got}
    # n**3 times the variance of dimension i (i = j) and of the sum of i and j.
    spread = {(i, j): n * (n * q - (rest[i] if i == j else rest[i] + rest[j]) ** 2) for (i, j), q in square.items()}
    exact = [[Fraction(0)] * size for _ in range(size)]
    for (i, j), v in spread.items():
        exact[i][j] = exact[j][i] = Fraction(v, n ** 3) if i == j else Fraction(v - spread[i, i] - spread[j, j], 2 * n ** 3)
    return exact, np.array([[float(v) for v in row] for row in exact])


@dataclass
class Whitening:
    """Fitted components: ``axes`` has one in each column, with eigenvalues ``e`` from the largest; ``shares`` are e / trace(V)."""

    size: int
    n: int
    sums: list[int]
    axes: np.ndarray
    e: np.ndarray
    shares: np.ndarray | None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of the rows of x; NaN along components without variance."""
        numerator = self.n * x.astype(object) - np.array(self.sums, object) if self.wide(x) else self.n * x - np.array(self.sums, np.int64)
        centred = numerator.astype(float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.e > 0, centred @ self.axes / np.sqrt(self.e), np.nan)

    def wide(self, x: np.ndarray) -> bool:
        return self.n * int(np.abs(x).max(initial=0)) >= 2 ** 62 or max(map(abs, self.sums), default=0) >= 2 ** 62

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2 over the dimensions of each row; None beyond 64 bits."""
        if not self.wide(x):
            d = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * max(self.size, 1) < 2 ** 62:
                return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) if v < 2 ** 63 else None for v in (d * d).sum(1)]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors (size, x); None without any."""
    size, n, sums = totals(fit)
    if not n:
        return None
    exact, v = covariance(fit, size, n, sums)
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    e, axes = e[order], axes[:, order]
    trace = float(sum((exact[i][i] for i in range(size)), Fraction(0)))
    e = np.where(e > RANK_TOLERANCE * max(e.max(initial=0.0), 0.0), e, 0.0)
    return Whitening(size, n, sums, axes, e, e / trace if trace > 0 else None)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from the whitened values themselves."""
    own = np.flatnonzero(model.e > 0)
    if not len(own):
        return 0.0
    ddl = "i int, j int, v double"

    def run(batches):
        # Row and column 0 hold the sums, the rest the products; the whitened values are centred, so doubles do.
        total = np.zeros((len(own) + 1, len(own) + 1))
        for b in batches:
            z = model.project(stacked(b.column(0), model.size))[:, own]
            z = np.column_stack([np.ones(len(z)), z])
            total += z.T @ z
        yield from batches_of(((i, j, float(v)) for (i, j), v in np.ndenumerate(total)), arrow_schema(ddl))

    rows = fit.filter(F.col("size") == model.size).select("x").mapInArrow(run, ddl)
    total = np.zeros((len(own) + 1, len(own) + 1))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row for each pair of components
        total[r.i, r.j] = r.v
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(len(own))).max())


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """OUT: a row for each usable vector and component."""
    spark = table.sparkSession
    rows = vectors(table, id_col, vector_col)
    fit = materialize(rows.select("size", "x").distinct(), "whiten-fit")
    model = fit_whitening(fit, components)
    if model is None:
        return spark.createDataFrame([], OUT)
    error = identity_error(fit, model)

    def run(batches):
        import pyarrow as pa

        schema, k = arrow_schema(OUT), len(model.e)
        for b in batches:
            b = b.filter(pa.array([s == model.size for s in b.column(1).to_pylist()], pa.bool_()))
            x = stacked(b.column(2), model.size)
            white = model.project(x).ravel()
            each = np.repeat(np.arange(len(x)), k)
            share = pa.nulls(len(each), pa.float64()) if model.shares is None else pa.array(np.tile(model.shares, len(x)))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(white, mask=np.isnan(white)), share, pa.array(np.full(len(each), error))], schema=schema)

    return rows.mapInArrow(run, OUT)
