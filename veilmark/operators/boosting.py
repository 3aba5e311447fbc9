"""Gradient boosting of logistic loss by histograms, for many weightings of the same rows at once.

Features are cut into bins by their quantiles once. While the largest model's rows
are few (`WHOLE`, counted first), each model's rows go once to one task, which grows
all its trees. Beyond that a level of all models' trees is one pass: for each model,
node, feature and bin the sums of weights, residuals and curvatures, which a task
adds up over its rows and Spark over the tasks. The driver holds these sums, which
grow with models, features and bins, and the trees, never rows. Rows carry their
margins, rewritten after every few trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.durable import Scratch
from veilmark.operators.logistic import design, present, total

#: Bytes of bins of the largest model up to which a model's rows meet in a task.
WHOLE = 8 << 20
#: Trees after which margins are written.
EVERY = 10
#: A split must lower the squared error by more than this; gains are compared at nine decimals, so that sums in any order choose alike.
LEAST, DECIMALS = 1e-9, 9


@dataclass
class Trees:
    """For each model its starting log-odds and whether it was fitted; trees as arrays by model: the feature and the last bin of the left side of each inner node (a heap; without a split all go left), and the leaves' steps."""

    edges: list[list[float]]
    fill: list[float]
    start: np.ndarray
    fitted: np.ndarray
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, rows: DataFrame, features: list[str]) -> DataFrame:
        """rows with __bins, those of their features; a missing value has the bin of the feature's median."""
        ends = F.array(*(F.split(F.lit(" ".join(map(repr, e))), " ").cast("array<double>") if e else F.array().cast("array<double>") for e in self.edges))
        fill = F.split(F.lit(" ".join(map(repr, self.fill))), " ").cast("array<double>")
        cut = F.zip_with(F.zip_with(design(features), fill, lambda v, m: F.coalesce(v, m)), ends, lambda v, e: F.size(F.filter(e, lambda c: c < v)).cast("double"))
        return rows.withColumn("__bins", cut)

    def leaf(self, tree: int, model: int, x: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node after so many levels, from 0 on the left."""
        feature, last, _ = self.trees[tree]
        return descend(feature[model], last[model], x, levels)

    def margins(self, model: int, x: np.ndarray, first: int, start: np.ndarray) -> np.ndarray:
        """The margins after the trees from the first on, given those before."""
        out = start.copy()
        for t in range(first, len(self.trees)):
            out += self.trees[t][2][model][self.leaf(t, model, x, self.depth)]
        return out


def descend(feature: np.ndarray, last: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for level in range(levels):
        node = (1 << level) - 1 + at
        at = 2 * at + (x[np.arange(len(x)), feature[node]] > last[node])
    return at


def _splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sums (node, feature, bin, [w, g, h]) the best cut of each node: feature, last bin on the left (infinite if none helps), and the sums of both sides."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    n, g = left[..., 0], left[..., 1]
    rest, other = whole[..., 0] - n, whole[..., 1] - g
    inside = (n > 1e-9) & (rest > 1e-9)
    with np.errstate(all="ignore"):
        gain = np.where(inside, np.round(g**2 / n + other**2 / rest - whole[..., 1] ** 2 / whole[..., 0], DECIMALS), 0.0)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    nodes, bins = np.arange(len(gain)), gain.shape[2]
    feature, last = at // bins, (at % bins).astype(float)
    none = flat[nodes, at] <= LEAST
    feature, last = np.where(none, 0, feature), np.where(none, np.inf, last)
    mine = np.where(none[:, None], whole[:, 0, 0, :], left[nodes, feature, at % bins, :])
    return feature, last, np.stack([mine, whole[:, 0, 0, :] - mine], axis=1)


def fit(rows: DataFrame, features: list[str], label: str, weights: str, trees: int = 100, depth: int = 2, rate: float = 0.1, bins: int = 32) -> Trees:
    """The ensembles of rows with a label (1, or anything else) and an array of weights, as many as models.

    A tree fits the residuals by least squares; a leaf takes one Newton step, times the rate. Bins are cut at quantiles of all rows,
    whatever their weights. A model without weight in either class is not fitted. Null and NaN features take the median of all rows.
    """
    f = len(features)
    with Scratch(rows.sparkSession) as scratch:
        raw = rows.select(F.when(F.col(label) == 1, 1.0).when(F.col(label).isNotNull(), 0.0).alias("__y"), F.transform(weights, lambda w: w.cast("double")).alias("__w"), *features).where("__y is not null and __w is not null")
        shares = [i / bins for i in range(1, bins)]
        cut = raw.agg(*(F.percentile_approx(present(name), [0.5, *shares], 10_000).alias(f"c{i}") for i, name in enumerate(features)), F.max(F.size("__w")).alias("models")).first()  # medians, then cuts
        m = cut["models"] or 0
        model = Trees([sorted(set((cut[f"c{i}"] or [])[1:])) for i in range(f)], [(cut[f"c{i}"] or [0.0])[0] for i in range(f)], np.zeros(m), np.zeros(m, bool), depth)
        if not m:
            return model
        kept = scratch.put(model.binned(raw, features).select(F.col("__bins").alias("x"), "__y", "__w").toDF("x", "y", "w"))
        counts = total(kept, 3 * m, lambda x, y, w: np.concatenate([w.sum(0), w.T @ y, (w > 0).sum(0)]))
        n, ups, most = counts[:m], counts[m : 2 * m], counts[2 * m :].max()
        model.fitted = (ups > 0) & (ups < n)
        share = np.where(model.fitted, ups / np.maximum(n, 1e-300), 0.5)
        model.start = np.log(share / (1 - share))
        if most * f * _kind(bins).itemsize <= WHOLE:
            model.trees += _apart(kept, model, m, f, bins, trees, depth, rate)
            return model
        kept = scratch.put(kept.withColumn("w", F.concat("w", F.array(*map(F.lit, model.start.tolist())))))  # weights, then margins
        done = 0
        for t in range(trees):
            if t - done >= EVERY:
                kept, done = scratch.put(_written(kept, model, done, m)), t
            model.trees.append(_grown(kept, model, done, m, f, bins, depth, rate))
        return model


def _kind(bins: int) -> np.dtype:
    """The smallest numbers that hold a bin."""
    return np.min_scalar_type(bins - 1)


def _apart(kept: DataFrame, model: Trees, m: int, f: int, bins: int, trees: int, depth: int, rate: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trees of all models, each model's grown by a task that gets its rows once, in blocks."""
    kind, on, start, inner = _kind(bins), np.flatnonzero(model.fitted), model.start, (1 << depth) - 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "w"))
                x, y = x.astype(kind), batch.column("y").to_numpy(zero_copy_only=False)
                for i in on:
                    own = np.flatnonzero(w[:, i])
                    if len(own):
                        yield pa.record_batch([pa.array([i], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x[own], y[own], w[own, i]))], ["model", "x", "y", "w"])

    def grown(rows: pa.Table) -> pa.Table:
        x, y, w = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("x", kind), ("y", float), ("w", float)))
        i = rows.column("model")[0].as_py()
        found = _alone(np.ascontiguousarray(x.reshape(-1, f).T), y, w, start[i], bins, trees, depth, rate)
        return pa.table({"model": pa.array([i], pa.int32()), **{c: pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for c, v in zip(("feature", "last", "steps"), found, strict=True)}})

    # As many parts as models, for models are few and each is much work.
    each = kept.mapInArrow(blocks, "model int, x binary, y binary, w binary").repartition(max(len(on), 1), "model")
    feature, last, steps = np.zeros((trees, m, inner), np.int64), np.full((trees, m, inner), np.inf), np.zeros((trees, m, 1 << depth))
    for row in each.groupBy("model").applyInArrow(grown, "model int, feature array<double>, last array<double>, steps array<double>").collect():  # trees of each model
        for out, c in ((feature, "feature"), (last, "last"), (steps, "steps")):
            out[:, row["model"]] = np.reshape(row[c], (trees, -1))
    return list(zip(feature, last, steps, strict=True))


def _alone(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: float, bins: int, trees: int, depth: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees of one model from all its rows (x: their bins by feature)."""
    f, n = x.shape
    feature, last, steps = np.zeros((trees, (1 << depth) - 1), np.int64), np.full((trees, (1 << depth) - 1), np.inf), np.zeros((trees, 1 << depth))
    sums = lambda at, s, cells: np.stack([np.bincount(at + v if cells > bins else v, weights=s, minlength=cells) for v in x]).reshape(f, -1, bins).transpose(1, 0, 2)
    weights, margin, rows = sums(0, w, bins), np.full(n, start), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, at = w * (y - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, cells = (1 << level) - 1, (1 << level) * bins
            held = sums(at * bins, w, cells) if level else weights
            feature[t, first : 2 * first + 1], last[t, first : 2 * first + 1], _ = _splits(np.stack([held, sums(at * bins, g, cells)], axis=-1))
            at = 2 * at + (x[feature[t, first + at], rows] > last[t, first + at])
        up, h = (np.bincount(at, weights=s, minlength=1 << depth) for s in (g, w * p * (1 - p)))
        steps[t] = rate * np.where(h > 1e-12, up / np.where(h > 1e-12, h, 1.0), 0.0)
        margin += steps[t][at]
    return feature, last, steps


def _sums(kept: DataFrame, model: Trees, done: int, m: int, f: int, bins: int, feature: np.ndarray, last: np.ndarray, level: int) -> np.ndarray:
    """(model, node, feature, bin, [w, g, h]) of a level of the tree that is growing."""
    cells, on = (1 << level) * bins, np.flatnonzero(model.fitted)

    def part(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros((m, f * cells, 3))
        for i in on:
            own = np.flatnonzero(w[:, i])
            if len(own):
                mine, weight = x[own], w[own, i]
                p = 1 / (1 + np.exp(-model.margins(i, mine, done, w[own, m + i])))
                at = (descend(feature[i], last[i], mine, level) * bins)[:, None] + mine.astype(np.int64) + np.arange(f) * cells
                for k, s in enumerate((weight, weight * (y[own] - p), weight * p * (1 - p))):
                    out[i, :, k] = np.bincount(at.ravel(), weights=np.repeat(s, f), minlength=f * cells)
        return out

    return total(kept, m * f * cells, part, 3).reshape(m, f, 1 << level, bins, 3).transpose(0, 2, 1, 3, 4)


def _grown(kept: DataFrame, model: Trees, done: int, m: int, f: int, bins: int, depth: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next tree of each model: a pass for each level."""
    inner = (1 << depth) - 1
    feature, last, steps = np.zeros((m, inner), np.int64), np.full((m, inner), np.inf), np.zeros((m, 1 << depth))
    for level in range(depth):
        sums = _sums(kept, model, done, m, f, bins, feature, last, level)
        first = (1 << level) - 1
        for i in np.flatnonzero(model.fitted):
            feature[i, first : 2 * first + 1], last[i, first : 2 * first + 1], sides = _splits(sums[i])
            if level == depth - 1:
                g, h = sides.reshape(-1, 3)[:, 1], sides.reshape(-1, 3)[:, 2]
                steps[i] = rate * np.where(h > 1e-12, g / np.where(h > 1e-12, h, 1.0), 0.0)
    return feature, last, steps


def _written(kept: DataFrame, model: Trees, done: int, m: int) -> DataFrame:
    """The rows with the margins after all trees so far."""

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "w"))
                w = w.copy()
                for i in range(m):
                    w[:, m + i] = model.margins(i, x, done, w[:, m + i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * 2 * m, pa.int32()), pa.array(w.ravel()))
                yield pa.record_batch([batch.column("x"), batch.column("y"), lists], ["x", "y", "w"])

    return kept.mapInArrow(onward, "x array<double>, y double, w array<double>")


def decide(rows: DataFrame, features: list[str], model: Trees, models: str, name: str = "scores") -> DataFrame:
    """rows with the log-odds of those models that an array column of theirs names, in its order; NaN for models that weren't fitted."""

    kept = [c for c in rows.columns if c != name]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                asked = batch.column(models)
                bins, numbers = batch.column("__bins").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1), asked.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False))])
                row, out = np.repeat(np.arange(len(asked)), np.diff(ends)), np.full(len(numbers), np.nan)
                for i in np.unique(numbers):
                    if model.fitted[i]:
                        at = np.flatnonzero(numbers == i)
                        out[at] = model.margins(i, bins[row[at]], 0, np.full(len(at), model.start[i]))
                yield pa.record_batch([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))], [*kept, name])

    return model.binned(rows, features).select(*kept, "__bins").mapInArrow(scored, rows.select(*kept).withColumn(name, F.array(F.lit(0.0))).schema)
