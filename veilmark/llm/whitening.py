"""Whitening of embeddings, with a covariance that is exact up to its last division.

Entries become integers. The fit list holds each distinct vector once; its sums
S and its products of n*x - S are integers, too, and so are merged in any
order. Digit-slice GEMM: n*x - S is split into limbs of `LIMB` bits, so that a
float64 product of two limb matrices over `ROWS` rows stays below 2^53 and is
exact; the products are put together again as big integers, which leave a task
in digits of 32 bits and are added up by Spark. Only the d * (d + 1) / 2 sums
reach the driver, which divides by n^3 once and finds the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import release, small_batches, spare, stored
from veilmark.llm.vectors import dimension, floors, matrix, whole

#: Rows of one product, and bits of a limb: ROWS * 2^(2 * LIMB) < 2^53.
ROWS, LIMB = 4096, 20
#: Bits of the digits in which big integers travel.
DIGIT = 32
#: A direction with less of the variance than this has none, but for rounding.
NIL = 1e-13


@dataclass
class Model:
    """n vectors were fitted. `sums` by dimension; `values` and `axes` (columns) by falling eigenvalue, as many as asked for; `explained` by component; `scaled` has the axes over the roots of their values, nil where there is no variance."""

    n: int
    largest: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def varied(self) -> np.ndarray:
        return self.explained > NIL

    @property
    def scaled(self) -> np.ndarray:
        return np.where(self.varied, self.axes / np.sqrt(np.where(self.varied, self.values, 1.0)), 0.0)


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers, or where these are too small as Python's."""
    if 2 * n * max(largest, 1) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(z: np.ndarray, count: int) -> list[np.ndarray]:
    """The limbs of each integer, lowest first, as doubles; the last one carries the sign."""
    low = [(z >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(count - 1)]
    return [part.astype(np.float64) for part in (*low, z >> (LIMB * (count - 1)))]


def products(z: np.ndarray, bits: int) -> np.ndarray:
    """z'z as Python's integers, by exact float64 products of limbs. bits: of the largest magnitude."""
    parts = limbs(z, -(-(bits + 1) // LIMB))
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[: i + 1]):
            one = (a.T @ b).astype(np.int64).astype(object)
            out += (one if i == j else one + one.T) << (LIMB * (i + j))
    return out


def _digits(totals: np.ndarray) -> pa.RecordBatch:
    """Each integer of a list as (its place, digit's place, digit); the highest digit carries the sign."""
    at, place, digit = [], [], []
    for i, v in enumerate(totals):
        k, v = 0, int(v)
        while not -(1 << DIGIT) < v < 1 << DIGIT:
            at.append(i), place.append(k), digit.append(v & ((1 << DIGIT) - 1))
            k, v = k + 1, v >> DIGIT
        at.append(i), place.append(k), digit.append(v)
    return pa.record_batch([pa.array(at, pa.int64()), pa.array(place, pa.int32()), pa.array(digit, pa.int64())], ["at", "place", "digit"])


def _merged(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """The sums over the fit list of `part`, which gives `size` integers for a block of vectors."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            x = matrix(batch.column(0), d)
            for start in range(0, len(x), ROWS):
                total += part(x[start : start + ROWS])
        yield _digits(total)
        release()

    out = [0] * size
    for at, place, digit in fit.mapInArrow(tasks, "at bigint, place int, digit bigint").groupBy("at", "place").agg(F.sum("digit").alias("digit")).collect():
        out[at] += digit << (DIGIT * place)
    return out


def _added(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The same for doubles."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(matrix(batch.column(0), d))
        yield pa.record_batch([pa.array(range(size), pa.int64()), pa.array(total)], ["at", "value"])

    out = np.zeros(size)
    for at, value in fit.mapInArrow(tasks, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[at] = value
    return out


def fit(vectors: DataFrame, x: str, components: int) -> Model | None:
    """The model of a column of integer vectors (array<bigint>, all of one length), each distinct one once; none without vectors."""
    small_batches(vectors.sparkSession)
    with stored(vectors.select(F.col(x).alias("x")).distinct()) as table:
        n, d, high, low = table.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
        if not n:
            return None
        largest = max(abs(high), abs(low))
        sums = _merged(table, d, d, lambda x: x.sum(axis=0) if largest < 1 << 50 else x.astype(object).sum(axis=0))
        bits = (2 * n * largest).bit_length()
        upper = np.triu_indices(d)
        spread = _merged(table, d, len(upper[0]), lambda x: products(centred(x, n, sums, largest), bits)[upper])
        cov = np.zeros((d, d))
        cov[upper] = [s / n**3 for s in spread]
        values, axes = np.linalg.eigh(np.triu(cov) + np.triu(cov, 1).T)
        total = sum(s for s, i, j in zip(spread, *upper, strict=True) if i == j) / n**3
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        model = Model(n, largest, sums, values, axes, values / total if total else np.zeros(len(values)), 0.0)
        k = len(values)
        mean = _added(table, d, k, lambda x: project(x, model).sum(axis=0)) / n

        def spread_of(x: np.ndarray) -> np.ndarray:
            w = project(x, model) - mean
            return (w.T @ w).ravel()

        error = np.abs(_added(table, d, k * k, spread_of).reshape(k, k) / n - np.eye(k))[np.ix_(model.varied, model.varied)]
        model.identity_error = float(error.max(initial=0.0))
        return model


def project(x: np.ndarray, model: Model) -> np.ndarray:
    """x - S / n on the components, each over the root of its variance."""
    return (centred(x, model.n, model.sums, model.largest) / model.n).astype(np.float64) @ model.scaled


def whiten(vectors: DataFrame, vec: str, scale: int = 64, offset: int = 1_000_000, components: int = 16) -> tuple[DataFrame, Model | None]:
    """The rows with a vector of finite entries, with `whitened` (array<double> by component) and `deviation` (decimal(38,0): the sum over the dimensions of (n*x - S)^2), and the model.

    An entry c counts as x = floor(scale * c) + offset, saturating at 2^62. Rows
    whose vector is null, holds a null, NaN or infinite entry, or has another
    length than most vectors (the larger length in a tie) are left out, as are
    empty vectors. Repeated rows are all returned and fitted once. A direction
    without variance has null values; sums beyond 38 digits are null. Without
    vectors the result is empty and there is no model. Other columns stay,
    columns named like the new ones are replaced.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x, made = spare(vectors, "x"), spare(vectors, "made")
    good = vectors.where(whole(vec))
    d = dimension(good, vec)
    ints = good.where(F.size(vec) == d).withColumn(x, floors(vec, scale, offset)) if d else good.limit(0).withColumn(x, floors(vec, scale, offset))
    model = fit(ints, x, components) if d else None
    if model is None:
        return ints.drop(x).withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("decimal(38,0)")}), None
    return ints.withColumn(made, _scored(model, d)(F.col(x))).withColumns({"whitened": F.col(made)["whitened"], "deviation": F.col(made)["deviation"]}).drop(x, made), model


def _scored(model: Model, d: int) -> Callable[[Column], Column]:
    held = model.varied.tolist()
    small = d * (2 * model.n * model.largest) ** 2 < 1 << 62

    def rows(x: pa.Array) -> pa.Array:
        block = matrix(x, d)
        z = centred(block, model.n, model.sums, model.largest)
        fits = small or (z.dtype != object and d * int(np.abs(z).max(initial=0)) ** 2 < 1 << 62)
        if fits:
            deviation = pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
        else:
            exact = (z.astype(object) ** 2).sum(axis=1)
            deviation = pa.array([str(v) if v < 10**38 else None for v in exact], pa.string()).cast(pa.decimal128(38, 0))
        w = project(block, model)
        flat = pa.array(w.ravel(), mask=np.tile(~np.array(held), len(w)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
        return pa.StructArray.from_arrays([lists, deviation], ["whitened", "deviation"])

    rows.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(rows, "whitened array<double>, deviation decimal(38,0)")
