"""Embedding whitening: covariances from sums of squares alone, by polarisation, then eigenvectors.

Every entry c of a vector becomes the whole number x = floor(64 * c) + 1000000,
so that all sums are exact. With y = x - m, where m is the whole number nearest
to the mean of the dimension, two passes over the rows give

* per dimension i the sum of y_i and of y_i^2, and
* per pair i < j the sum of (y_i + y_j)^2.

The second holds for the pair sum y_i + y_j what the first holds for one
dimension: a sum of squares about the mean, n * sum(y^2) - (sum y)^2, in whole
numbers of any size. Differences of these variances are twice the cross
covariances: 2 cov(i, j) = var(i + j) - var(i) - var(j). No product of two
dimensions is ever summed, and nothing is rounded before the matrix is
complete; then each entry is rounded once, to double.

Tasks send one row per dimension and pair, whatever they read, and Spark adds
them as decimals. The driver gets d * (d + 3) / 2 numbers, takes the
eigenvectors, and tasks project their rows on them. A third pass over the
whitened rows measures how far their covariance is from the identity.

Defined cases: vectors that are NULL or hold NULL or non-finite entries are
left out. Vectors of each length are a table of their own, with its own fit
(one length as a rule; at most ``MOST_FITTED`` numbers in all fits together).
x is held inside +-2^62. A component without variance (eigenvalue within
rounding of 0) has ``whitened`` NULL and takes no part in the identity error;
where no variance is at all (one row, equal rows) ``explained`` is NULL.
A deviation beyond long is NULL (``deviation_text`` has all its digits). NULL
and repeated ids are rows like others; empty vectors give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Components returned.
COMPONENTS = 32
#: Fixed values of the contract: scale and offset of the whole numbers.
SCALE, OFFSET = 64.0, 1_000_000
#: Entries are held inside this bound.
BOUND = 1 << 62
#: Entries summed at a time (at most 16,384 rows), and the largest |y| whose squares so many rows can sum in 64 bits.
BLOCK, SMALL = 1 << 20, 1 << 23
#: Numbers in all fits together that the driver takes (a matrix of 4,096 dimensions).
MOST_FITTED = 1 << 24
#: Sums are carried as high * 2^64 + low.
LIMB = 1 << 64

SUMS = "length int, i int, j int, high decimal(38,0), low decimal(38,0)"
WHITE = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
    ("deviation_text", pa.string()), ("whitened", pa.float64()), ("explained", pa.float64()),
])
WHITE_DDL = "vec_id long, component int, n long, deviation long, deviation_text string, whitened double, explained double"


@dataclass
class Fit:
    """The fit of the vectors of one length."""

    n: int
    centre: np.ndarray  # whole numbers near the means
    total: list[int]  # sums of x - centre
    vectors: np.ndarray  # one column per component
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray
    usable: np.ndarray  # components with variance


def whole(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and whole numbers (rows by dimensions) of the usable vectors of a batch."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64())
    entries = flat.to_numpy(zero_copy_only=False)  # NULL becomes NaN
    firsts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        step = min(1 << 14, max(1, BLOCK // int(size)))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            block = entries[firsts[some][:, None] + np.arange(size)]
            good = np.isfinite(block).all(axis=1)
            with np.errstate(over="ignore"):
                scaled = np.floor(block[good] * SCALE)
            held = np.clip(scaled, -float(BOUND), float(BOUND)).astype(np.int64)
            yield int(size), some[good], np.minimum(held, BOUND - OFFSET) + OFFSET


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre: 64-bit where the squares of a block can be summed so, Python's whole numbers otherwise."""
    low, high = int(x.min()) - int(centre.max()), int(x.max()) - int(centre.min())
    if max(abs(low), abs(high)) <= SMALL:
        return x - centre
    return x.astype(object) - centre.astype(object)


def first_sums(x: np.ndarray, totals: dict) -> None:
    """Sum of x per dimension at (i, -1) and the number of rows at (-1, -1)."""
    small = np.abs(x).max() < (1 << 48)
    for i, s in enumerate((x if small else x.astype(object)).sum(axis=0)):
        totals[i, -1] = totals.get((i, -1), 0) + int(s)
    totals[-1, -1] = totals.get((-1, -1), 0) + len(x)


def squares(x: np.ndarray, centre: np.ndarray, totals: np.ndarray) -> None:
    """Add the sums of y_i^2 at (i, i) and of (y_i + y_j)^2 at (i, j), i < j."""
    columns = np.ascontiguousarray(centred(x, centre).T)
    for i, own in enumerate(columns):
        pair = columns[i:] + own
        pair[0] = own
        totals[i, i:] += (pair * pair).sum(axis=1)


def summed(vectors: DataFrame, centres: dict[int, np.ndarray] | None) -> dict[int, dict[tuple[int, int], int]]:
    """Exact sums over all rows, by length: of x without ``centres``, of squares with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: dict[int, dict] = {}
        square: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in whole(batch.column(0)):
                if not len(x):
                    continue
                if centres is None:
                    first_sums(x, plain.setdefault(size, {}))
                else:
                    squares(x, centres[size], square.setdefault(size, np.zeros((size, size), object)))
        for size, matrix in square.items():
            plain[size] = {(i, j): matrix[i, j] for i in range(size) for j in range(i, size)}
        rows = [(size, i, j, *divmod(int(s), LIMB)) for size, of in plain.items() for (i, j), s in of.items()]
        for at in range(0, len(rows), 100_000):
            size, i, j, high, low = zip(*rows[at:at + 100_000], strict=True)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38), pa.decimal128(38)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip((size, i, j, high, low), kinds, strict=True)],
                names=["length", "i", "j", "high", "low"],
            )

    rows = vectors.mapInArrow(run, SUMS).groupBy("length", "i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in rows.collect():  # d * (d + 1) / 2 rows for each length
        out.setdefault(r.length, {})[r.i, r.j] = int(r.high) * LIMB + int(r.low)
    return out


def covariance(n: int, total: list[int], square: dict[tuple[int, int], int]) -> np.ndarray:
    """From sums of squares of dimensions and pair sums to all covariances; each entry rounded once."""
    d = len(total)
    spread = {}  # n^2 times the variance, a whole number
    for (i, j), s in square.items():
        t = total[i] if i == j else total[i] + total[j]
        spread[i, j] = n * s - t * t
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = spread[i, i] / (n * n)
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n * n)
    return out


def fit(table: DataFrame, vector: str = "embedding") -> dict[int, Fit]:
    """A fit for every length of vectors in the table."""
    vectors = table.select(vector)
    first = summed(vectors, None)
    if sum(size * size for size in first) > MOST_FITTED:
        raise ValueError(f"vectors of lengths {sorted(first)} need more than {MOST_FITTED} numbers")
    centres, totals = {}, {}
    for size, sums in first.items():
        n = sums[-1, -1]
        means = [(2 * sums[i, -1] + n) // (2 * n) for i in range(size)]  # nearest whole number
        centres[size] = np.array(means, dtype=np.int64)
        totals[size] = [sums[i, -1] - n * means[i] for i in range(size)]
    second = summed(vectors, centres) if first else {}
    fits = {}
    for size, square in second.items():
        n = first[size][-1, -1]
        values, components = np.linalg.eigh(covariance(n, totals[size], square))
        values, components = np.maximum(values[::-1], 0.0), components[:, ::-1]
        trace = float(values.sum())
        usable = values > values[0] * size * np.finfo(float).eps
        explained = values / trace if trace > 0 else np.full(size, np.nan)
        fits[size] = Fit(n, centres[size], totals[size], np.ascontiguousarray(components), values, explained, usable)
    return fits


def projected(x: np.ndarray, of: Fit, k: int) -> np.ndarray:
    """Whitened values (rows by components); NaN where a component has no variance."""
    y = centred(x, of.centre)
    mean = np.array([t / of.n for t in of.total])
    scale = np.where(of.usable[:k], np.sqrt(of.values[:k]), np.nan)
    return (y.astype(np.float64) - mean) @ of.vectors[:, :k] / scale


def deviations(x: np.ndarray, of: Fit) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact."""
    y = centred(x, of.centre)
    total = max(abs(t) for t in of.total)
    largest = of.n * int(np.abs(y).max()) + total
    if largest * largest * y.shape[1] < 1 << 63:
        return (((y * of.n - np.array(of.total)).astype(np.int64) ** 2).sum(axis=1)).tolist()
    z = y.astype(object) * of.n - np.array(of.total, dtype=object)
    return (z * z).sum(axis=1).tolist()


def whiten(table: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, deviation_text, whitened, explained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for size, rows, x in whole(batch.column(1)):
                if not len(rows):
                    continue
                of, k = fits[size], min(size, components)
                white, far = projected(x, of, k), deviations(x, of)
                exact = [d if d < 1 << 63 else None for d in far]
                each = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), of.n, np.int64)), pa.array(exact, pa.int64()).take(pa.array(each)),
                    pa.array([str(d) for d in far], pa.string()).take(pa.array(each)),
                    pa.array(white.ravel(), from_pandas=True),
                    pa.array(np.tile(of.explained[:k], len(rows)), from_pandas=True),
                ], schema=WHITE)

    return table.select(id_col, vector).mapInArrow(run, WHITE_DDL)


def identity_error(table: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in whole(batch.column(0)):
                if len(x):
                    white = projected(x, fits[size], min(size, components))
                    white = np.column_stack((np.ones(len(x)), white[:, fits[size].usable[:white.shape[1]]]))
                    sums[size] = sums.get(size, 0) + white.T @ white
        for size, matrix in sums.items():
            i, j = np.indices(matrix.shape)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(matrix.size, size, np.int32)), pa.array(i.ravel().astype(np.int32)),
                pa.array(j.ravel().astype(np.int32)), pa.array(matrix.ravel()),
            ], names=["length", "i", "j", "s"])

    rows = table.select(vector).mapInArrow(run, "length int, i int, j int, s double").groupBy("length", "i", "j").agg(
        F.sum("s").alias("s")
    ).collect()  # (components + 1)^2 rows for each length
    worst = None
    for size in {r.length for r in rows}:
        mine = [r for r in rows if r.length == size]
        width = 1 + max(r.i for r in mine)
        matrix = np.zeros((width, width))
        for r in mine:
            matrix[r.i, r.j] = r.s / fits[size].n
        mean = matrix[0, 1:]
        off = matrix[1:, 1:] - np.outer(mean, mean) - np.eye(width - 1)
        if off.size:
            worst = max(worst or 0.0, float(np.abs(off).max()))
    return worst


def whitened(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``whiten`` with the table's own fit, and ``identity_error`` beside it."""
    fits = fit(table, vector)
    error = F.lit(identity_error(table, fits, components, vector)).cast("double")
    return whiten(table, fits, components, id_col, vector).withColumn("identity_error", error)
