"""Many fits in one pass: logistic ones against their conditions of an optimum, boosted ones against trees grown row by row."""

import random

import numpy as np
import pytest

from veilmark.operators import boosting, detector, logistic

KIND = "id bigint, pair bigint, y int, a double, b double, c double, w array<int>"


def table(spark, seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 2
        a, b = y + r.gauss(0, 1), r.choice([0.0, 1.0, 1.0, 2.0])
        rows.append((i, i // 2, y, r.choice([a, a, a, None, float("nan")]), b, 7.0, [1, int(i % 3 > 0), r.randrange(3), y, 0]))
    return rows, spark.createDataFrame(rows, KIND).repartition(3)


def filled(rows, w):
    x = np.array([[np.nan if v is None else v for v in row[3:6]] for row in rows], float)
    held = np.repeat(x, w, axis=0)
    medians = np.nanmedian(held, axis=0)
    x = np.where(np.isnan(x), medians, x)
    held = np.repeat(x, w, axis=0)
    sd = held.std(axis=0)
    return (x - held.mean(axis=0)) / np.where(sd < 1e-12, 1, sd)


@pytest.mark.parametrize("seed", [1, 2])
def test_logistic_fits_are_optima(spark, seed):
    rows, df = table(spark, seed)
    models = logistic.fit(df, ["a", "b", "c"], "y", "w", penalty=0.5)
    assert models.fitted.tolist() == [True, True, True, False, False] and models.betas.shape == (5, 4)
    y = np.array([row[2] for row in rows])
    for m in range(3):
        w = np.array([row[6][m] for row in rows])
        z = np.concatenate([filled(rows, w), np.ones((len(rows), 1))], axis=1)
        slope = z.T @ (w * (1 / (1 + np.exp(-z @ models.betas[m])) - y)) + np.array([0.5, 0.5, 0.5, 0]) * models.betas[m]
        assert np.abs(slope).max() < 1e-6 and models.betas[m][2] == 0
    raw = {row.id: row.s for row in df.crossJoin(models.table(spark).where("model = 1")).select("id", logistic.decision(logistic.design(["a", "b", "c"])).alias("s")).collect()}
    w = np.array([row[6][1] for row in rows])
    want = np.concatenate([filled(rows, w), np.ones((len(rows), 1))], axis=1) @ models.betas[1]
    assert np.allclose([raw[row[0]] for row in rows], want)


def test_models_of_nothing(spark):
    none = spark.createDataFrame([], KIND)
    assert logistic.fit(none, ["a"], "y", "w").betas.shape[0] == 0 and not len(boosting.fit(none, ["a"], "y", "w", trees=2).start)


def brute(x, y, w, trees, rate):
    """Depth two, on bins, row by row."""
    f = np.full(len(y), np.log((w @ y / w.sum()) / (1 - w @ y / w.sum())))

    def best(g, at):
        found = (1e-9, None)
        for j in range(x.shape[1]):
            for v in sorted(set(x[:, j])):
                left, right = at & (x[:, j] <= v), at & (x[:, j] > v)
                n, m = w[left].sum(), w[right].sum()
                if n and m:
                    gain = round((w[left] @ g[left]) ** 2 / n + (w[right] @ g[right]) ** 2 / m - (w[at] @ g[at]) ** 2 / w[at].sum(), 9)
                    if gain > found[0]:
                        found = (gain, x[:, j] > v)
        return found[1]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, step = y - p, np.zeros(len(y))
        cut = best(g, np.ones(len(y), bool))
        for side in [np.ones(len(y), bool)] if cut is None else [~cut, cut]:
            again = best(g, side)
            for leaf in [side] if again is None else [side & ~again, side & again]:
                h = w[leaf] @ (p * (1 - p))[leaf]
                step[leaf] = rate * (w[leaf] @ g[leaf]) / h if h > 1e-12 else 0
        f = f + step
    return f


def test_boosted_trees_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(boosting, "EVERY", 2)
    rows, df = table(spark, 5)
    features = ["a", "b", "c"]
    model = boosting.fit(df, features, "y", "w", trees=5, bins=8)
    assert model.fitted.tolist() == [True, True, True, False, False] and model.edges[2] == [7.0]
    binned = {r.id: r["__bins"] for r in model.binned(df, features).collect()}
    scores = {r.id: r.scores for r in boosting.decide(df.selectExpr("*", "array(2, 0, 1, 3) AS asked"), features, model, "asked").collect()}
    x, y = np.array([binned[row[0]] for row in rows]), np.array([row[2] for row in rows], float)
    for place, m in enumerate((2, 0, 1)):
        want = brute(x, y, np.array([row[6][m] for row in rows], float), 5, 0.1)
        assert np.allclose([scores[row[0]][place] for row in rows], want)
    assert all(np.isnan(s[3]) for s in scores.values())


def test_folds_keep_pairs_apart(spark):
    _, df = table(spark, 3)
    dealt, k = detector.dealt(df.selectExpr("id AS entity_id", "pair AS pair_id", "y AS label", "a"), repeats=3, folds=4)
    rows = dealt.collect()
    assert k == 4 and all(len(r.folds) == 3 and set(r.folds) <= set(range(4)) for r in rows)
    for repeat in range(3):
        by = {}
        for r in rows:
            by.setdefault(r.pair_id, set()).add(r.folds[repeat])
        sizes = [sum(1 for v in by.values() if v == {f}) for f in range(4)]
        assert all(len(v) == 1 for v in by.values()) and max(sizes) - min(sizes) <= 1


def test_boosting_moves_rows_once_or_passes_over_them(spark, monkeypatch):
    """Few rows: some jobs in all, however many trees. Many: passes over all rows. Both give the same trees."""
    _, df = table(spark, 7, 90)
    features, tracker = ["a", "b", "c"], spark.sparkContext.statusTracker()

    def grown(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            model = boosting.fit(df, features, "y", "w", trees=12, bins=8)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return model, len(tracker.getJobIdsForGroup(group))

    once, jobs = grown("boosting once")
    monkeypatch.setattr(boosting, "WHOLE", 0)
    passes, more = grown("boosting in passes")
    assert jobs <= 12 < 24 <= more and len(once.trees) == len(passes.trees) == 12
    for (f1, last1, step1), (f2, last2, step2) in zip(once.trees, passes.trees, strict=True):
        on = once.fitted
        assert (f1[on] == f2[on]).all() and (last1[on] == last2[on]).all() and np.allclose(step1[on], step2[on])
