"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers x = floor(scale c); a constant added to them would cancel. One pass adds up n, the sums S and the
products of all rows without rounding (in floating-point blocks small enough to be exact, then
as integers); rows never leave their partition, only one table of d (d + 1) / 2 sums each.
The scatter n sum(x x') - S S' is an integer matrix, n^2 times the covariance. Its
characteristic polynomial is computed modulo primes in Spark tasks and put together by Chinese
remaindering; its largest roots are isolated to high precision and their vectors found
by inverse iteration (``charpoly``). A second pass centres, projects and scales every row.

The driver sees sums and vectors bounded by the dimension alone (MAX_DIMENSION).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelift.llm import charpoly
from linelift.llm.common import materialize, need_columns, ship_package

COMPONENTS = 8
SCALE = 1024
MAX_DIMENSION = 1024
"""Dimensions that the driver and a task hold a square matrix of."""
PRIMES_PER_TASK = 16
LARGEST = float(1 << 62)
"""A row with an entry whose integer would be as large in size is dropped like a non-finite one."""
LIMB_BITS = 21
SUM_BITS = 40
SUMS = "i int, j int, s0 long, s1 long, s2 long, s3 long"


def integer_rows(column: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are valid, their entries floor(scale c) as int64)."""
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    fits = (lengths == dimension) & ~np.asarray(lists.is_null())
    flat = lists.filter(pa.array(fits)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)  # a null is read as NaN
        good = (np.abs(values) < LARGEST).all(axis=1)
    at = np.flatnonzero(fits)
    fits[at[~good]] = False
    return fits, values[good].astype(np.int64)


def products(rows: np.ndarray) -> np.ndarray:
    """rows' rows as Python integers, exact: blocks whose products a double holds."""
    d = rows.shape[1]
    total = np.zeros((d, d), object)
    most = int(np.abs(rows).max(initial=0))
    if most < 1 << 26:
        step = max(1, (1 << 53) // max(1, most * most))
        for at in range(0, len(rows), step):
            block = rows[at:at + step].astype(np.float64)
            total += (block.T @ block).astype(np.int64).astype(object)
        return total
    limbs, rest = [], rows
    while len(limbs) < 3:
        limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rest = rest >> LIMB_BITS
    limbs[2] += rest.astype(np.float64) * (1 << LIMB_BITS)  # the signed rest
    step = 1 << 53 - 2 * LIMB_BITS
    for at in range(0, len(rows), step):
        for a, x in enumerate(limbs):
            for b, y in enumerate(limbs):
                part = (x[at:at + step].T @ y[at:at + step]).astype(np.int64).astype(object)
                total += part << LIMB_BITS * (a + b)
    return total


def _partial_sums(dimension: int, scale: int):
    """n at (-1, -1), sums at (i, -1), products at (i, j >= i), in parts of SUM_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            _, rows = integer_rows(batch.column(0), dimension, scale)
            if len(rows):
                n += len(rows)
                total += products(rows)
                # 2^22 numbers below 2^40 at a time stay exact in 64 bits
                high, low = rows >> 32, rows & 0xFFFFFFFF
                sums += low.sum(axis=0).astype(object) + (high.sum(axis=0).astype(object) << 32)
        if not n:
            return
        i, j = np.triu_indices(dimension)
        values = [n, *sums.tolist(), *total[i, j].tolist()]
        mask = (1 << SUM_BITS) - 1
        parts = [[int(v) >> SUM_BITS * k & mask for v in values] for k in range(3)]
        parts.append([int(v) >> SUM_BITS * 3 for v in values])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(dimension), *i.tolist()], pa.int32()),
             pa.array([-1] * (1 + dimension) + j.tolist(), pa.int32()),
             *[pa.array(p, pa.int64()) for p in parts]], ["i", "j", "s0", "s1", "s2", "s3"])

    return run


class Fit(NamedTuple):
    """n, the sums of floor(scale c), eigenvalues of the covariance, unit vectors, trace."""

    n: int
    sums: list[int]
    values: list[Decimal]
    vectors: list[list[Decimal]]
    trace: Decimal


def scatter(vectors: DataFrame, column: str, dimension: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and n sum(x x') - S S' of all valid rows."""
    rows = (vectors.select(column).mapInArrow(_partial_sums(dimension, scale), SUMS)
            .groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)]).collect())
    value = {(r["i"], r["j"]): sum(r[f"s{k}"] << SUM_BITS * k for k in range(4)) for r in rows}
    if not value:
        return 0, [], []
    n, sums = value[-1, -1], [value[i, -1] for i in range(dimension)]
    return n, sums, [[n * value[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dimension)]
                     for i in range(dimension)]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), lowest power first; a share of the primes per task."""
    d = len(matrix)
    primes = charpoly.primes_for(
        2 * charpoly.coefficient_bound(sum(matrix[i][i] for i in range(d)), d))
    shares = [primes[at:at + PRIMES_PER_TASK] for at in range(0, len(primes), PRIMES_PER_TASK)]
    given = spark.sparkContext.broadcast((matrix, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, shares = given.value
        for batch in batches:
            for share in batch.column(0).to_pylist():
                found = charpoly.residues(matrix, shares[share])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shares[share], pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))],
                    ["prime", "residues"])

    rows = spark.range(0, len(shares), 1, len(shares)).mapInArrow(
        run, "prime long, residues array<long>").collect()
    given.destroy()
    return charpoly.combine([r["prime"] for r in rows], [r["residues"] for r in rows])


def fit(vectors: DataFrame, *, column: str = "embedding", components: int = COMPONENTS,
        scale: int = SCALE) -> Fit | None:
    """What ``whiten`` needs to know of all valid rows; None without any."""
    need_columns(vectors, column)
    ship_package(vectors.sparkSession)
    sizes = (vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).groupBy(F.size(column).alias("d"))
             .agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first())
    if sizes is None:
        return None
    dimension = sizes["d"]
    if dimension > MAX_DIMENSION:
        raise ValueError(f"vectors of {dimension} entries; at most {MAX_DIMENSION} are handled")
    n, sums, matrix = scatter(vectors, column, dimension, scale)
    if not n:
        return None
    roots = charpoly.largest_roots(characteristic_polynomial(vectors.sparkSession, matrix), components)
    with localcontext() as context:
        context.prec = charpoly.DIGITS
        values, found = [], []
        for root, times in roots:
            for v in charpoly.null_vectors(matrix, root, times):
                values.append(Decimal(root.numerator) / Decimal(root.denominator) / n / n)
                found.append(v if max(v, key=abs) > 0 else [-x for x in v])
        trace = Decimal(sum(matrix[i][i] for i in range(dimension))) / n / n
    return Fit(n, sums, values[:components], found[:components], trace)


def _square_sums(rows: np.ndarray) -> list[int]:
    """Exact sums of squares of rows of integers below 2^61 in size, of at most 2^20 entries."""
    high, low, half = rows >> 31, rows & _HALF, []
    for part in (high * high, high * low, low * low):  # each below 2^62
        half.append([(a << 31) + b for a, b in zip((part >> 31).sum(axis=1).tolist(),
                                                   (part & _HALF).sum(axis=1).tolist())])
    return [(a << 62) + (b << 32) + c for a, b, c in zip(*half)]


_HALF = (1 << 31) - 1


def _project(model: Fit, scale: int):
    """(vec_id, vector) -> (vec_id, deviation, whitened: one number per component)."""
    with localcontext() as context:
        context.prec = charpoly.DIGITS
        weights = np.array([[float(x / e.sqrt()) for x in v] for v, e in zip(model.vectors, model.values)]
                           ).reshape(len(model.values), len(model.sums)).T
    n, sums, k = model.n, np.array(model.sums, object), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, rows = integer_rows(batch.column(1), len(sums), scale)
            most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, model.sums))
            if most < 1 << 61:
                centred = rows * n - sums.astype(np.int64)
                deviation = _square_sums(centred)
            else:
                centred = rows.astype(object) * n - sums
                deviation = (centred * centred).sum(axis=1).tolist()
            whitened = (centred / n).astype(np.float64) @ weights
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(fits)).cast(pa.int64()),
                 pa.array([v if v < 10 ** 38 else None for v in deviation], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * k, whitened.ravel())],
                ["vec_id", "deviation", "whitened"])

    return run


PROJECTED = "vec_id long, deviation decimal(38,0), whitened array<double>"


def whiten(vectors: DataFrame, *, column: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """Whitened components of every valid row of ``vectors`` (vec_id and ``column``, an array).

    One row per valid input row and component, numbered from 1 by falling eigenvalue: vec_id,
    component, n (valid rows), deviation (decimal; sum over dimensions of (n x - S)^2, exact, null
    beyond 38 digits), whitened (x - S / n projected on the unit eigenvector, over the square root
    of its eigenvalue), explained (the eigenvalue's share of the trace), identity_error (largest
    absolute entry of the whitened rows' covariance, measured on them, minus the identity).
    x is floor(scale c); adding a constant to it changes nothing.

    A row is dropped if its vector is null or empty, holds a null, NaN or infinite entry (or one
    whose integer needs more than 62 bits), or is not of the most frequent length (the
    larger of equally frequent ones). Components without variance are left out, so equal rows
    alone give no result, like an empty table. For a repeated eigenvalue the components are an
    orthonormal basis of its space. Null ids and repeated rows stay; other columns are ignored.
    """
    need_columns(vectors, "vec_id", column)
    spark = vectors.sparkSession
    model = fit(vectors, column=column, components=components, scale=scale)
    if model is None or not model.values:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), "
                                     "whitened double, explained double, identity_error double")
    rows = materialize(vectors.select("vec_id", column).mapInArrow(_project(model, scale), PROJECTED), "whitened")
    count = len(model.values)
    moments = rows.agg(
        *[F.avg(F.col("whitened")[a]).alias(f"m{a}") for a in range(count)],
        *[F.avg(F.col("whitened")[a] * F.col("whitened")[b]).alias(f"p{a}_{b}")
          for a in range(count) for b in range(a, count)]).first()
    error = max(abs(moments[f"p{a}_{b}"] - moments[f"m{a}"] * moments[f"m{b}"] - (a == b))
                for a in range(count) for b in range(a, count))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
                    F.lit(error).alias("identity_error")))
