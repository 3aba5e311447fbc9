"""Many weighted logistic regressions over the same rows at once.

Each row carries a weight for every model: 0 or 1 in a fold, a number of draws in
a resample. A pass over the rows adds up, for all models together, what a Newton
step needs (X'WX and X'W(y - p), by blocks of an Arrow batch), and Spark adds up
the tasks' sums; the driver holds models, never rows. Missing values take their
model's median; columns are standardised with their model's mean and deviation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.operators.durable import Scratch

#: Newton steps at most, and the largest change that ends them.
STEPS, ENOUGH = 50, 1e-9
#: What holds the bias, which is not penalised.
FREE = 1e-9


@dataclass
class Models:
    """A row for each model: medians, means and deviations of the features, coefficients of the standardised ones with the bias last, the weight of its rows, and whether both classes had any."""

    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    betas: np.ndarray
    weights: np.ndarray
    fitted: np.ndarray

    def table(self, spark) -> DataFrame:
        """The fitted models for raw rows: model, medians, slopes, bias. A row for each model."""
        slopes = self.betas[:, :-1] / self.deviations
        bias = self.betas[:, -1] - (slopes * self.means).sum(axis=1)
        rows = [(m, self.medians[m].tolist(), slopes[m].tolist(), float(bias[m])) for m in np.flatnonzero(self.fitted).tolist()]
        return spark.createDataFrame(rows, "model int, medians array<double>, slopes array<double>, bias double")


def present(feature: str) -> Column:
    """A feature as a double; null if it is missing."""
    return F.when(~F.isnan(F.col(feature).cast("double")), F.col(feature).cast("double"))


def design(features: list[str]) -> Column:
    """The features as one array of doubles; missing ones are null."""
    return F.array(*map(present, features))


def decision(x: Column) -> Column:
    """The log-odds of a row under the model that a join with `Models.table` put beside it."""
    filled = F.zip_with(x, "medians", lambda v, m: F.coalesce(v, m))
    return F.aggregate(F.zip_with(filled, "slopes", lambda v, s: v * s), F.col("bias"), lambda a, b: a + b)


def total(rows: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int = 1) -> np.ndarray:
    """The sums over all rows (x, y, w: arrays of doubles with NaN for missing, a label, arrays of weights) of `part`, which gives `size` times `width` numbers for a block of them. Places where all are 0 don't travel."""
    names = [f"v{i}" for i in range(width)]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, width))
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                x, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("x", "w"))
                out += part(x, batch.column("y").to_numpy(zero_copy_only=False), w).reshape(size, width)
        at = np.flatnonzero(out.any(axis=1))
        yield pa.record_batch([pa.array(at), *(pa.array(np.ascontiguousarray(out[at, i])) for i in range(width))], ["at", *names])

    kind = "at bigint, " + ", ".join(f"{n} double" for n in names)
    found = rows.select("x", "y", "w").mapInArrow(tasks, kind).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((size, width))
    for i, n in enumerate(names):
        out[found.column("at").to_numpy(), i] = found.column(n).to_numpy()
    return out.ravel()


def _medians(rows: DataFrame, missing: np.ndarray, models: int) -> np.ndarray:
    """Weighted medians of the features that have missing values, by model: halfway between the lower and the upper one, 0 without any value."""
    out = np.zeros((models, len(missing)))
    some = np.flatnonzero(missing).tolist()
    if some:
        each = rows.select("x", F.posexplode("w").alias("model", "w")).where("w > 0").select("x", "model", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
        value = lambda f: F.nanvl(F.get("x", F.lit(f)), F.lit(None))
        found = each.groupBy("model").agg(*(((F.percentile_approx(value(f), 0.5) - F.percentile_approx(-value(f), 0.5)) / 2).alias(f"f{f}") for f in some))
        for row in found.collect():
            out[row["model"], some] = [row[f"f{f}"] or 0.0 for f in some]
    return out


def fit(rows: DataFrame, features: list[str], label: str, weights: str, penalty: float = 1.0) -> Models:
    """The models of rows with a label (1, or anything else) and an array of weights, as many as models, L2-penalised by `penalty`.

    A model without weight in either class is not fitted. Null and NaN features are missing; a feature without values counts as 0.
    """
    f = len(features)
    with Scratch(rows.sparkSession) as scratch:
        nan = F.lit(float("nan"))
        kept = scratch.put(rows.select(F.transform(design(features), lambda v: F.coalesce(v, nan)).alias("x"), F.when(F.col(label) == 1, 1.0).when(F.col(label).isNotNull(), 0.0).alias("y"), F.transform(weights, lambda w: w.cast("double")).alias("w")).where("y is not null and w is not null"))
        m = kept.agg(F.max(F.size("w"))).first()[0] or 0
        gaps = lambda x, y, w: np.concatenate([w.sum(0), w.T @ y, (w.T @ np.isnan(x)).ravel(), (w.T @ np.nan_to_num(x)).ravel()])
        first = total(kept, 2 * m + 2 * m * f, gaps)
        n, ups, missing, sums = first[:m], first[m : 2 * m], first[2 * m : 2 * m + m * f].reshape(m, f), first[2 * m + m * f :].reshape(m, f)
        fitted = (ups > 0) & (ups < n)
        medians = _medians(kept, missing.any(axis=0) if m else np.zeros(f, bool), m)
        least = np.maximum(n, 1e-300)[:, None]
        means = (sums + medians * missing) / least

        def squares(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.concatenate([w[:, i] @ (_filled(x, medians[i]) - means[i]) ** 2 for i in range(m)])

        deviations = np.sqrt(total(kept, m * f, squares).reshape(m, f) / least) if m else np.ones((0, f))
        deviations = np.where(deviations < 1e-12, 1.0, deviations)
        models = Models(medians, means, deviations, np.zeros((m, f + 1)), n, fitted)
        _newton(kept, models, penalty)
        return models


def _filled(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), medians, x)


def _newton(rows: DataFrame, models: Models, penalty: float) -> None:
    """Steps of all models that still move, one pass each."""
    f = models.betas.shape[1] - 1
    hold = np.full(f + 1, penalty)
    hold[-1] = FREE
    moving = np.flatnonzero(models.fitted)
    for _ in range(STEPS):
        if not len(moving):
            return
        size = (f + 1) * (f + 2)

        def step(x: np.ndarray, y: np.ndarray, w: np.ndarray, moving: np.ndarray = moving) -> np.ndarray:
            out = []
            for i in moving:
                z = np.concatenate([(_filled(x, models.medians[i]) - models.means[i]) / models.deviations[i], np.ones((len(x), 1))], axis=1)
                p = 1 / (1 + np.exp(-np.clip(z @ models.betas[i], -35, 35)))
                out += [(z * (w[:, i] * p * (1 - p))[:, None]).T @ z, (z.T @ (w[:, i] * (p - y)))[None]]
            return np.concatenate(out).ravel()

        sums = total(rows, len(moving) * size, step).reshape(len(moving), f + 2, f + 1)
        still = []
        for i, s in zip(moving, sums, strict=True):
            change = np.linalg.solve(s[:-1] + np.diag(hold), s[-1] + hold * models.betas[i])
            models.betas[i] -= min(1.0, 5.0 / max(np.abs(change).max(), 1e-12)) * change
            still.append(np.abs(change).max() >= ENOUGH)
        moving = moving[still]
