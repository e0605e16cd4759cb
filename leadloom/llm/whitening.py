"""Embedding whitening by refined eigenvectors of a distributed covariance.

Entries c become whole numbers x = floor(1024 c) + 100000, so all sums are exact: one pass adds up the entries, a second one
multiplies rows centred by the whole number next to the mean and adds up the products per cell (what is left of the
mean, below a half, is taken out of the sums without rounding). Tasks multiply batches; Spark adds the cells up.
Only n, the sums and the covariance, which no number of rows makes larger, reach the driver.

Eigenvectors start from a float32 decomposition. Ogita-Aishima iterations correct all of them at once by matrix products in extended
precision (numpy's longdouble), doubling the right digits each time. Eigenvalues closer together than the error in hand form a
cluster; the matrix within the span of its vectors, its mean taken out, is decomposed by itself, which tells the vectors apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import replace_columns, with_columns
from leadloom.session import materialize

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LIMB = 20  # bits of a factor: products of so many bits add up without rounding over a batch
BATCH = 4096
LARGEST = 1 << 61  # entries whose whole number would not fit count as not finite
ROUNDS = 40
DONE = 4e-16  # a correction that doubles do not show
STRAIGHT = 1e-10  # a loss of orthogonality that the next iteration squares
EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Fitted:
    """What is learnt from the vectors of one length."""

    n: int
    centre: np.ndarray  # whole numbers next to the means
    rest: list[int]  # sums of what the centre leaves
    vectors: np.ndarray  # columns are components
    values: np.ndarray
    total: float  # of the variances of all dimensions


def points(column: pa.Array):
    """(length, rows, whole numbers) of the vectors that take part, by length; at most ``BATCH`` rows at a time."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]).tolist():
        of = np.flatnonzero(lengths == length)
        for start in range(0, len(of), BATCH):
            rows = of[start:start + BATCH]
            held = column.take(pa.array(rows)).flatten()
            values = held.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)  # a NULL is not a number there
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(SCALE * values)
                fine = (np.abs(scaled) < LARGEST).all(1)
            if fine.any():
                yield length, rows[fine], scaled[fine].astype(np.int64) + OFFSET


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    return ((x >> 31).sum(0).astype(object) << 31) + (x & ((1 << 31) - 1)).sum(0).astype(object)


def exact_products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` of whole numbers without rounding, as Python integers: float64 products of limbs that cannot round."""
    limbs, rest = [], z
    while rest.any() or not limbs:
        low = ((rest + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for a, one in enumerate(limbs):
        for b, other in enumerate(limbs):
            out += (one.T @ other).astype(np.int64).astype(object) << (LIMB * (a + b))
    return out


def _sums(df: DataFrame, vector: str) -> dict[int, tuple[int, list[int]]]:
    """Per length the number of vectors and the sum of every dimension."""
    def add(batches):
        held = {}
        for batch in batches:
            for length, _, x in points(batch.column(0)):
                n, sums = held.get(length, (0, 0))
                held[length] = n + len(x), sums + exact_sums(x)
        for length, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()),
                                              pa.array([Decimal(s) for s in sums], EXACT)], names=["length", "i", "n", "total"])

    parts = df.select(vector).mapInArrow(add, "length int, i int, n long, total decimal(38,0)")
    rows = parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("length", "i").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.length, (r.n, []))[1].append(int(r.total))
    return out


def _products(df: DataFrame, vector: str, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per length the sums of products of the centred vectors."""
    def add(batches):
        held = {}
        for batch in batches:
            for length, _, x in points(batch.column(0)):
                held[length] = held.get(length, 0) + exact_products(x - centres[length])
        for length, sums in held.items():
            i, j = np.triu_indices(length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array([Decimal(s) for s in sums[i, j]], EXACT)], names=["length", "i", "j", "total"])

    parts = df.select(vector).mapInArrow(add, "length int, i int, j int, total decimal(38,0)")
    out = {length: np.zeros((length, length), object) for length in centres}
    for r in parts.groupBy("length", "i", "j").agg(F.sum("total").alias("total")).toLocalIterator():
        out[r.length][r.i, r.j] = out[r.length][r.j, r.i] = int(r.total)
    return out


def refined(matrix: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix (plus ``low``, the digits that it has no room for)."""
    wide = np.longdouble
    size = len(matrix)
    top = np.abs(matrix).max()
    if not top:
        return np.zeros(size), np.eye(size)
    unit = 2.0 ** np.frexp(top)[1]  # a power of two: exact, and nothing leaves the range of float32
    a = matrix.astype(wide) / unit + (0 if low is None else low.astype(wide) / unit)
    x = np.linalg.eigh((matrix / unit).astype(np.float32))[1].astype(wide)
    one, before, idle = np.eye(size, dtype=wide), np.inf, 0
    norm = float(np.linalg.norm(matrix / unit, 2))
    for _ in range(ROUNDS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding over a small gap would turn into a loss of orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        error = 2 * (np.linalg.norm((s - np.diag(values)).astype(float), 2) + norm * np.linalg.norm(r.astype(float), 2))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > error
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        step = float(np.abs(e).max())
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.diff(values[order]) > error) + 1
        clusters = [c for c in np.split(order, cuts) if len(c) > 1]
        idle = idle + 1 if step > before / 2 and np.abs(r).max() <= STRAIGHT else 0
        before = min(before, step)
        if step <= DONE and not clusters or idle == 2:  # what is left is rounding: vectors of nearly equal values still turn by it
            break
        for cluster in clusters:  # within the span of a cluster: decomposed by itself, its mean taken out
            own = x[:, cluster]
            inner = own.T @ (a @ own) - values[cluster].mean() * (own.T @ own)
            largest = np.abs(inner).max()
            if largest:
                x[:, cluster] = own @ np.linalg.eigh((inner / largest).astype(float))[1].astype(wide)
    x = x / np.sqrt((x * x).sum(0))
    values = np.einsum("ij,ij->j", x, a @ x) * unit
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


def covariance(n: int, products: np.ndarray, rest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The covariance, divisor n, from exact sums: doubles, and the digits that they have no room for."""
    size = len(rest)
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            exact = Fraction(n * products[i, j] - rest[i] * rest[j], n * n)
            high[i, j] = high[j, i] = float(exact)
            low[i, j] = low[j, i] = float(exact - Fraction(high[i, j]))
    return high, low


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Fitted]:
    """The model per length of the vectors that are not NULL, have no NULL and only finite entries; none for an empty table.

    Vectors of other lengths are other spaces, each with a fit list of its own. Components without variance (fewer rows than
    dimensions, equal rows) cannot be scaled to one and are left out.
    """
    sums = _sums(df, vector)
    centres = {length: np.array([(2 * s + n) // (2 * n) for s in total], np.int64) for length, (n, total) in sums.items()}
    products = _products(df, vector, centres) if centres else {}
    out = {}
    for length, (n, total) in sums.items():
        rest = [s - n * int(c) for s, c in zip(total, centres[length])]
        high, low = covariance(n, products[length], rest)
        values, vectors = refined(high, low)
        fine = int(np.count_nonzero(values[:components] > length * np.finfo(float).eps * max(values[0], 0)))
        out[length] = Fitted(n, centres[length], rest, vectors[:, :fine], values[:fine], float(np.trace(high)))
    return out


def deviations(z: np.ndarray, fitted: Fitted) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exactly; NULL if it does not fit 64 bits."""
    most = fitted.n * (int(np.abs(z).max()) + 1)  # a whole number next to the mean leaves less than n of a dimension's sum
    if z.shape[1] * most * most < 1 << 63:
        away = fitted.n * z - np.array(fitted.rest, np.int64)
        return (away * away).sum(1).tolist()
    away = fitted.n * z.astype(object) - np.array(fitted.rest, object)
    return [x if x < 1 << 63 else None for x in (away * away).sum(1).tolist()]


def transform(df: DataFrame, model: dict[int, Fitted], vector: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Add the whitened vector (array of doubles) and the exact deviation to every row; NULL for vectors that take no part.

    Columns of these names are replaced, all others pass through; rows that repeat stay.
    """
    schema = with_columns(df, [(out, T.ArrayType(T.DoubleType())), (deviation, T.LongType())])
    scaled = {length: (f, f.vectors / np.sqrt(f.values), np.array([r / f.n for r in f.rest])) for length, f in model.items()}

    def run(batches):
        for batch in batches:
            at = next(i for i, name in enumerate(batch.schema.names) if name.lower() == vector.lower())
            white, far = [None] * batch.num_rows, [None] * batch.num_rows
            for length, rows, x in points(batch.column(at)):
                if length in scaled:
                    fitted, turn, rest = scaled[length]
                    z = x - fitted.centre
                    for row, own, d in zip(rows.tolist(), ((z - rest) @ turn).tolist(), deviations(z, fitted)):
                        white[row], far[row] = own, d
            yield replace_columns(batch, [(out, pa.array(white, pa.list_(pa.float64()))), (deviation, pa.array(far, pa.int64()))])

    return df.mapInArrow(run, schema)


def identity_error(white: DataFrame, components: int, column: str = "whitened") -> float | None:
    """Largest absolute entry of the covariance of the vectors (one length) minus the identity; NULL without any."""
    if not components:
        return None
    means = white.agg(*[F.avg(F.get(column, F.lit(i))) for i in range(components)]).first()
    if means[0] is None:
        return None
    away = [F.get(column, F.lit(i)) - F.lit(means[i]) for i in range(components)]
    cells = [(i, j) for i in range(components) for j in range(i, components)]
    found = white.agg(*[F.avg(away[i] * away[j]) for i, j in cells]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(cells, found))


def whiten(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector that takes part and component: the id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows that repeat, or have no id, are rows like others. Without usable vectors the result is empty.
    """
    model = fit(df, vector, components)
    white = materialize(transform(df.select(F.col(row_id).alias("vec_id"), F.col(vector).alias("embedding")), model).where(F.col("whitened").isNotNull())
                        .select("vec_id", F.size("embedding").alias("length"), "whitened", "deviation"))
    parts = []
    for length, fitted in sorted(model.items()):
        own = white.where(F.col("length") == length)
        error = identity_error(own, len(fitted.values))
        shares = F.array(*[F.lit(float(v / fitted.total)) for v in fitted.values]) if len(fitted.values) else F.array().cast("array<double>")
        parts.append(own.select("vec_id", F.lit(fitted.n).cast("long").alias("n"), "deviation", F.lit(error).cast("double").alias("identity_error"),
                                shares.alias("shares"), F.posexplode("whitened").alias("at", "whitened")))
    empty = white.limit(0).select("vec_id", F.lit(0).cast("long").alias("n"), "deviation", F.lit(0.0).alias("identity_error"),
                                  F.array().cast("array<double>").alias("shares"), F.posexplode("whitened").alias("at", "whitened"))
    rows = parts[0] if parts else empty
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                       F.get("shares", F.col("at")).alias("explained"), "identity_error")
