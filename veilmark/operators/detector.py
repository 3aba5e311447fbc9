"""Pair-grouped cross-validated detectors of a barrier.

All folds of all repeats, and all resampled draws, are models over the same rows, which carry a weight for each of them. Imputation by
medians and standardising happen inside training folds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.hashing import digest
from veilmark.functions.metrics import detectability_state, resolvable_auc
from veilmark.operators import boosting, logistic, stats
from veilmark.operators.durable import durable, spread
from veilmark.operators.ordering import running
from veilmark.operators.stats import auc, poisson_weights

C = 1.0
# The second detector's trees, their depth and learning rate; the threshold of an invisible barrier.
TREES, DEPTH, RATE = 100, 2, 0.1
UNDETECTABLE = 0.60


def dealt(vectors: DataFrame, repeats: int = 5, folds: int = 5, seed: str = "17", by: str | None = None) -> tuple[DataFrame, int]:
    """vectors (pair_id, label and more) with `folds`: its pair's fold in each repeat; and how many folds there are.

    Folds are stratified: within a repeat, pairs of like make-up (numbers of each class) are dealt in turn, in the order of their
    hashes, so repeats deal pairs anew. A pair has the same folds in every group of `by`.
    """
    n = vectors.groupBy(*([by] if by else []), "label").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    k = max(2, min(folds, n))
    pairs = vectors.groupBy("pair_id").agg(F.count_if(F.col("label") == 1).alias("up"), F.count_if(F.col("label") == 0).alias("down"))
    each = pairs.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("h", digest(seed, F.col("repeat"), F.col("pair_id")))
    placed = running(each.withColumn("key", F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")), "key", [F.col("h"), F.col("pair_id")], {"place": F.lit(1)}, ("repeat", "up", "down"))
    found = placed.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat", ((F.col("place") - 1) % k).cast("int").alias("fold")))), lambda s: s["fold"]).alias("folds"))  # one for each repeat
    return vectors.join(found, "pair_id"), k


def fold_weights(k: int, group: Column | None = None, groups: int = 1) -> Column:
    """Weights of the models (group, repeat, fold) in that order: 1 in the row's own group, but in the model's own fold."""
    own = lambda there: F.transform("folds", lambda f: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: ((f != j) & there).cast("int")))
    if group is None:
        return F.flatten(own(F.lit(True)))
    return F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: own(g == group))))


def out_of_fold(vectors: DataFrame, features: list[str], repeats: int = 5, folds: int = 5, seed: str = "17", kind: str = "logreg_primary", by: str | None = None) -> DataFrame:
    """vectors: entity_id, pair_id, label, features. Scores of each entity from folds that its pair was not in: repeat, entity_id, pair_id, label, score, and by.

    Folds are those of `dealt`; training folds of one class are skipped. All folds of all repeats, and of all groups of `by` (a few),
    are fitted together. kind: logreg_primary or gbt_secondary (histogram boosting of `TREES` trees).
    """
    rows, k = dealt(vectors, repeats, folds, seed, by)
    more = [by] if by else []
    rows = durable(spread(rows.select("entity_id", "pair_id", F.col("label").cast("int").alias("label"), "folds", *more, *features), "entity_id"))  # few rows, each with a weight for every model
    groups = sorted(r[0] for r in rows.select(by).distinct().collect()) if by else []
    group = (F.array_position(F.array(*map(F.lit, groups)), F.col(by)) - 1).cast("int") if groups else None
    rows = rows.withColumn("__w", fold_weights(k, group, len(groups))).withColumn("__models", F.transform("folds", lambda f, repeat: ((F.lit(0) if group is None else group) * repeats + repeat) * k + f))
    kept = ["entity_id", "pair_id", "label", *more]
    if kind == "gbt_secondary":
        each = boosting.decide(rows, features, boosting.fit(rows, features, "label", "__w", TREES, DEPTH, RATE), "__models", "__scores").select(*kept, F.posexplode("__scores").alias("repeat", "score"))
        return each.where(~F.isnan("score")).select("repeat", *kept, "score")
    models = logistic.fit(rows, features, "label", "__w", 1 / C)
    asked = rows.select(*kept, logistic.design(features).alias("x"), F.posexplode("__models").alias("repeat", "model"))
    scored = asked.join(F.broadcast(models.table(rows.sparkSession)), "model")  # a row for each group, repeat and fold
    return scored.select("repeat", *kept, logistic.decision(F.col("x")).alias("score"))


def cv_auc(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Mean AUC over repeats, and the list."""
    if by is None:
        each = auc(scores, by="repeat")
        return each.agg(F.avg("auc").alias("auc"), F.array_sort(F.collect_list("auc")).alias("auc_by_repeat"))
    each = stats.weighted_aucs(scores, [by, "repeat"], "score", (F.col("label") == 1).cast("int"), (F.col("label") == 0).cast("int"))
    return each.groupBy(by).agg(F.avg("auc").alias("auc"), F.array_sort(F.collect_list("auc")).alias("auc_by_repeat"))


def importance(vectors: DataFrame, features: list[str], draws: int = 50, seed: str = "19") -> DataFrame:
    """Mean coefficient of each feature and its percentile interval over resampled pairs, each as often as it is drawn. All draws are fitted together."""
    drawn = poisson_weights(seed, F.sequence(F.lit(0), F.lit(draws - 1)), F.col("pair_id"))
    pairs = vectors.select("pair_id").distinct().withColumn("__w", drawn)
    models = logistic.fit(vectors.join(pairs, "pair_id"), features, "label", "__w", 1 / C)
    fits = models.betas[models.fitted, :-1]
    rows = [(f, float(v.mean()), float(np.quantile(v, 0.025)), float(np.quantile(v, 0.975))) for f, v in zip(features, fits.T, strict=True)] if len(fits) else []  # a row for each draw and feature
    return vectors.sparkSession.createDataFrame(rows, "feature string, point double, lo double, hi double")


def detect(vectors: DataFrame, features: list[str], kind: str = "logreg_primary", repeats: int = 5, folds: int = 5, draws: int = 100, permutations: int = 100, seed: str = "17", threshold: float = UNDETECTABLE, by: str | None = None) -> DataFrame:
    """One row on a detector, for each group of `by`: detector, auc (mean over repeats), auc_by_repeat, lo, hi (pairs resampled, scores averaged over repeats), p, n_pairs, state, undetectable, resolvable.

    With one class, or where no fold could be fitted, the AUC is 0.5 with no width, p is null and nothing is claimed. Groups are fitted
    and resampled together, in one pass each.
    """
    own = by or "__all"
    rows = vectors if by else vectors.withColumn(own, F.lit(""))
    pairs = rows.groupBy(own).agg(F.count_distinct("pair_id").alias("n_pairs"))
    scores = durable(out_of_fold(rows, features, repeats, folds, seed, kind, own))
    mean = durable(scores.groupBy(own, "entity_id", "pair_id", "label").agg(F.avg("score").alias("score")))
    ends = stats.auc_intervals(mean, own, draws=max(draws, permutations), seed=seed, permute=seed)
    seen = pairs.join(cv_auc(scores, own), own, "left").join(ends, own, "left")  # a row for each group
    none = F.col("auc").isNull()
    half = lambda c: F.when(none, 0.5).otherwise(F.col(c)).alias(c)
    state = F.when(none, "inconclusive").otherwise(detectability_state(F.col("lo"), F.col("hi"))).alias("state")
    out = seen.select(own, F.lit(kind).alias("detector"), half("auc"), F.when(none, F.array(F.lit(0.5))).otherwise(F.col("auc_by_repeat")).alias("auc_by_repeat"), half("lo"), half("hi"), F.when(~none, F.col("p")).alias("p"), "n_pairs", state, (~none & (F.col("hi") <= threshold)).alias("undetectable"), resolvable_auc(F.col("n_pairs")).alias("resolvable"))
    return durable(out if by else out.drop(own))


def detectors(vectors: DataFrame, primary: list[str], secondary: list[str], q: float = 0.1, by: str | None = None, **how) -> DataFrame:
    """Both detectors, one row each, for each group of `by`; the p-values of all but the primary one are adjusted together (p_adjusted), the primary's stands. In a group the secondary one is the only such test, so its p stands, too."""
    both = detect(vectors, primary, "logreg_primary", by=by, **how).unionByName(detect(vectors, secondary, "gbt_secondary", by=by, **how))
    if by:
        return both.withColumn("p_adjusted", F.col("p"))
    tests = stats.benjamini_hochberg(both.where("detector <> 'logreg_primary' and p is not null").select(F.col("detector").alias("name"), "p"), q=q)
    return both.join(F.broadcast(tests.select(F.col("name").alias("detector"), "p_adjusted")), "detector", "left").withColumn("p_adjusted", F.coalesce("p_adjusted", "p"))  # two rows


class Adversary:
    """The detector that a method is calibrated against: fitted once, on the dev side only, and apart from the one that reports."""

    def __init__(self, vectors: DataFrame, features: list[str]):
        """vectors: label, features: a row for each entity of the dev side."""
        self.features = features
        self.models = logistic.fit(vectors.withColumn("__w", F.array(F.lit(1))), features, "label", "__w", 1 / C)
        if not self.models.fitted.any():
            raise ValueError("the dev side needs both classes")

    def score(self, vectors: DataFrame) -> DataFrame:
        """vectors with `score`, as one expression."""
        medians, slopes, bias = self.models.table(vectors.sparkSession).select("medians", "slopes", "bias").first()
        model = {"medians": F.array(*map(F.lit, medians)), "slopes": F.array(*map(F.lit, slopes))}
        filled = F.zip_with(logistic.design(self.features), model["medians"], lambda v, m: F.coalesce(v, m))
        return vectors.withColumn("score", F.aggregate(F.zip_with(filled, model["slopes"], lambda v, s: v * s), F.lit(bias), lambda a, b: a + b))

    def auc(self, vectors: DataFrame) -> DataFrame:
        """The AUC on other entities; 0.5 where a class is missing."""
        return auc(self.score(vectors)).select(F.coalesce("auc", F.lit(0.5)).alias("auc"))


def transfer_auc(vectors: DataFrame, scores: DataFrame) -> DataFrame:
    """AUC of scores that were made elsewhere (entity_id, score), on these entities' labels."""
    return auc(vectors.select("entity_id", "label").join(scores.select("entity_id", "score"), "entity_id"))


def strongest(coefficients: DataFrame, k: int = 8) -> DataFrame:
    """The k features of the largest coefficients by size, ties by name: feature, point, lo, hi, place."""
    order = Window.orderBy(F.abs("point").desc(), "feature")  # a row for each feature
    return coefficients.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
