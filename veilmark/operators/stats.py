"""Statistics: AUC by midrank, adjusted p-values, cluster bootstrap, group-preserving permutation, splits and bands."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.hashing import digest, draw
from veilmark.operators.durable import spread
from veilmark.operators.ordering import cuts, range_of, row_number, running


def auc(scored: DataFrame, score: str = "score", label: str = "label", by: str | None = None) -> DataFrame:
    """AUC with ties at one half; null where a class is missing. Rows: by (if any), n_pos, n_neg, auc.

    Scores are counted before they are ordered, so what is ranked are distinct scores.
    """
    keys = [by] if by else []
    counts = scored.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg"))
    if by:
        w = Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
        below = counts.withColumn("upto", F.sum("neg").over(w))
    else:
        below = running(counts, score, [], {"upto": F.col("neg")})
    total = below.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0)).alias("wins"))
    return total.select(*keys, "n_pos", "n_neg", (F.col("wins") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", name: str = "name", q: float = 0.1) -> DataFrame:
    """tests with p_adjusted and rejected (at rate q). Tests are few: one row each."""
    order = Window.orderBy(p, name)
    ranked = tests.withColumn("__rank", F.row_number().over(order)).withColumn("__m", F.count("*").over(Window.partitionBy()))
    after = order.rowsBetween(0, Window.unboundedFollowing)
    adjusted = ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(after))))
    return adjusted.withColumn("rejected", F.col("p_adjusted") <= q).drop("__rank", "__m")


#: Chances, in 2^32nds, that a Poisson number of mean one is at most 0, 1, 2 and so on.
POISSON = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10))


def poisson_weight(seed: str, at: Column, cluster: Column) -> Column:
    """How often a cluster is drawn in a draw: a Poisson number of mean one from the cluster's own hash, so no draw has to know how many clusters there are."""
    return poisson_weights(seed, F.array(at), cluster)[0]


def poisson_weights(seed: str, draws: Column, cluster: Column) -> Column:
    """The same for an array of draws; a hash is a lambda's argument, so it is made once."""
    return F.transform(F.transform(draws, lambda d: F.substring(digest(seed, d, cluster), 1, 8)), _poisson)


def _poisson(word: Column) -> Column:
    """From eight hex digits, which stand in the order of their numbers. The word is a lambda's argument, for it is looked at more than once."""
    out = F.lit(len(POISSON))
    for k, t in reversed(list(enumerate(POISSON))):
        out = F.when(word < f"{t:08x}", k).otherwise(out)
    return out


def _draws(first: int, end: int) -> Column:
    return F.sequence(F.lit(first).cast("bigint"), F.lit(end - 1).cast("bigint"))


def cluster_bootstrap(values: DataFrame, cluster: str, statistic: Callable[[Callable[[Column], Column]], Column], draws: int = 200, level: float = 0.95, seed: str = "boot", once: bool = False) -> DataFrame:
    """Point and percentile interval of any statistic of weighted sums, under resampling of clusters: point, lo, hi, n_clusters.

    `statistic` gets a function that sums a column, each row weighing as often as its cluster is drawn, and returns the statistic of such
    sums, e.g. lambda total: total(F.col("x")) / total(F.lit(1.0)). A draw is one group of a partial aggregate, so what is shuffled is a row
    for each draw and task; the point is one more draw, in which all weigh one, so rows are read once. once: a cluster has one row, so they
    are counted on the way. Without rows all is 0; with fewer than two clusters the interval is the point.
    """
    kept = values.where(F.col(cluster).isNotNull())
    # Weights come from a generator, which makes them once; a column would be made again in each sum and filter.
    drawn = kept.select("*", F.posexplode(F.concat(F.array(F.lit(1)), poisson_weights(seed, _draws(0, draws), F.col(cluster)))).alias("__draw", "__w"))
    each = drawn.groupBy("__draw").agg(statistic(lambda c: F.sum(F.when(F.col("__w") > 0, c * F.col("__w")))).alias("m"), F.count(F.lit(1)).alias("rows"))
    tail = (1 - level) / 2
    m = F.when(F.col("__draw") > 0, F.col("m"))
    one = each.agg(F.max(F.when(F.col("__draw") == 0, F.col("m"))).alias("point"), F.percentile(m, tail).alias("lo"), F.percentile(m, 1 - tail).alias("hi"), F.coalesce(F.max("rows"), F.lit(0).cast("bigint")).alias("n_clusters"))
    if not once:
        one = one.drop("n_clusters").crossJoin(F.broadcast(kept.agg(F.count_distinct(cluster).alias("n_clusters"))))  # one row each
    point = F.coalesce("point", F.lit(0.0))
    return one.select(point.alias("point"), *(F.when(F.col("n_clusters") < 2, point).otherwise(F.coalesce(e, point)).alias(e) for e in ("lo", "hi")), "n_clusters")


def bootstrap_mean(values: DataFrame, cluster: str, value: str, draws: int = 200, level: float = 0.95, seed: str = "boot") -> DataFrame:
    """Mean and percentile interval under resampling of clusters; a cluster enters as its sum and count."""
    sums = values.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("__s"), F.count(value).cast("double").alias("__k"))
    return cluster_bootstrap(sums, cluster, lambda total: total(F.col("__s")) / F.nullif(total(F.col("__k")), F.lit(0.0)), draws, level, seed, once=True)


def paired_bootstrap(pairs: DataFrame, cluster: str, a: str, b: str, draws: int = 200, level: float = 0.95, seed: str = "paired") -> DataFrame:
    """Mean difference a - b of measurements of the same cluster, and its interval; clusters without both are left out."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__diff", F.col(a) - F.col(b))
    return bootstrap_mean(both, cluster, "__diff", draws, level, seed)


def _weighted_auc(scored: DataFrame, score: str, pos: list[Column], neg: list[Column]) -> list[float | None]:
    """The AUC under each pair of weights (of a row as a positive, as a negative). Rows are summed by score first, and only distinct scores are ordered, once for all weights."""
    m = len(pos)
    counts = scored.groupBy(score).agg(*(F.sum(c).cast("double").alias(f"p{i}") for i, c in enumerate(pos)), *(F.sum(c).cast("double").alias(f"q{i}") for i, c in enumerate(neg)))
    ranked = running(counts, score, [], {f"u{i}": F.col(f"q{i}") for i in range(m)})
    row = ranked.agg(*(F.sum(F.col(f"p{i}") * (F.col(f"u{i}") - F.col(f"q{i}") / 2)).alias(f"w{i}") for i in range(m)), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(m)), *(F.sum(f"q{i}").alias(f"q{i}") for i in range(m))).first()
    return [row[f"w{i}"] / (row[f"p{i}"] * row[f"q{i}"]) if row[f"p{i}"] and row[f"q{i}"] else None for i in range(m)]


#: Draws that one pass over the scores weighs.
AT_ONCE = 50


def _quantile(values: list[float], q: float) -> float | None:
    """Linear between the neighbours."""
    if not values:
        return None
    at = q * (len(values) - 1)
    low, high = sorted(values)[math.floor(at)], sorted(values)[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def _sides(score: str, label: str) -> tuple[Column, Column]:
    return tuple((F.col(label) == v).cast("int") for v in (1, 0))


def auc_bootstrap(scored: DataFrame, pair: str = "pair_id", score: str = "score", label: str = "label", draws: int = 100, level: float = 0.95, seed: str = "auc") -> DataFrame:
    """AUC and percentile interval under resampling of pairs: n_pos, n_neg, auc, lo, hi, n_draws. Draws of one class are dropped."""
    rows = scored.where(F.col(score).isNotNull())
    is_pos, is_neg = _sides(score, label)
    found: list[float] = []
    for at in range(0, draws, AT_ONCE):
        weighed = rows.withColumn("__w", poisson_weights(seed, _draws(at, min(at + AT_ONCE, draws)), F.col(pair)))
        weights = [F.col("__w")[i] for i in range(min(AT_ONCE, draws - at))]
        found += [a for a in _weighted_auc(weighed, score, [is_pos * w for w in weights], [is_neg * w for w in weights]) if a is not None]
    tail = (1 - level) / 2
    lo, hi = _quantile(found, tail), _quantile(found, 1 - tail)
    return auc(scored, score, label).withColumns({"lo": F.lit(lo).cast("double"), "hi": F.lit(hi).cast("double"), "n_draws": F.lit(len(found)).cast("bigint")})


def permutation_p(scored: DataFrame, pair: str = "pair_id", score: str = "score", label: str = "label", draws: int = 200, seed: str = "perm") -> DataFrame:
    """Share of label permutations within pairs whose AUC reaches the observed one, plus one on both sides: observed, p, n_draws. A pair of one and one swaps on a coin's side; with fewer than four rows p is null."""
    rows = scored.where(F.col(score).isNotNull())
    is_pos, is_neg = _sides(score, label)
    found: list[float] = []
    for at in range(0, draws, AT_ONCE):
        flipped = rows.withColumn("__s", F.transform(_draws(at, min(at + AT_ONCE, draws)), lambda d: draw(F.lit(2), seed, d, F.col(pair)) == 1))
        swaps = [F.col("__s")[i] for i in range(min(AT_ONCE, draws - at))]
        found += [a for a in _weighted_auc(flipped, score, [F.when(s, is_neg).otherwise(is_pos) for s in swaps], [F.when(s, is_pos).otherwise(is_neg) for s in swaps]) if a is not None]
    seen = rows.agg(F.count("*").alias("__n"))
    each = F.array(*map(F.lit, found)) if found else F.array().cast("array<double>")
    reached = F.size(F.filter(each, lambda a: a >= F.col("observed") - 1e-12))
    p = F.when((F.col("__n") >= 4) & F.col("observed").isNotNull(), (reached + 1) / (len(found) + 1))
    return auc(scored, score, label).select(F.col("auc").alias("observed")).crossJoin(F.broadcast(seen)).select("observed", p.alias("p"), F.lit(len(found)).cast("bigint").alias("n_draws"))


def weighted_aucs(rows: DataFrame, by: list[str], score: str, pos: Column, neg: Column) -> DataFrame:
    """The AUC of each group of rows that weigh as positives and as negatives: by, auc (null where a class has no weight). Scores are summed before they are ordered."""
    counts = rows.groupBy(*by, score).agg(F.sum(pos).cast("double").alias("__p"), F.sum(neg).cast("double").alias("__q"))
    ranked = running(counts, score, [], {"__u": F.col("__q")}, tuple(by))
    wins = F.sum(F.col("__p") * (F.col("__u") - F.col("__q") / 2))
    return ranked.groupBy(*by).agg((wins / F.nullif(F.sum("__p") * F.sum("__q"), F.lit(0.0))).alias("auc"))


def auc_intervals(scored: DataFrame, by: str, pair: str = "pair_id", score: str = "score", label: str = "label", draws: int = 100, level: float = 0.95, seed: str = "auc", permute: str = "perm") -> DataFrame:
    """`auc_bootstrap` and `permutation_p` of every group at once, with draws as many of either: by, lo, hi, p.

    A row carries its weights in all draws. They are summed by score on the way, in ranges of the scores; a range gives its sums and its
    wins, so what meets by group is a row for each range.
    """
    rows = scored.where(F.col(score).isNotNull() & F.col(by).isNotNull()).withColumn(score, F.col(score).cast("double"))
    up, down = (F.coalesce(c, F.lit(0)) for c in _sides(score, label))
    swaps = F.transform(_draws(0, draws), lambda d: draw(F.lit(2), permute, d, F.col(pair)).cast("int"))
    asked = spread(rows, pair).select(by, F.col(score).alias("__score"), range_of(cuts(rows, score), F.col(score)).cast("int").alias("__range"), up.alias("__up"), down.alias("__down"), poisson_weights(seed, _draws(0, draws), F.col(pair)).alias("__w"), swaps.alias("__s"))
    kind, width = f"`{by}` {dict(scored.dtypes)[by]}, __range int", 1 + 2 * draws

    def summed(score: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct scores in order, and the sums of their rows."""
        order = np.argsort(score, kind="stable")
        there, first = np.unique(score[order], return_index=True)
        return there, np.add.reduceat(sides[order], first, axis=0)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                score, at, up, down = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__score", "__range", "__up", "__down"))
                w, s = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("__w", "__s"))
                up, down = up[:, None], down[:, None]
                # As positives, then as negatives: all alike, in each draw, with each swap.
                sides = np.concatenate([up, up * w, np.where(s == 1, down, up), down, down * w, np.where(s == 1, up, down)], axis=1).astype(np.int64)
                groups = batch.column(by).dictionary_encode()
                group = groups.indices.to_numpy(zero_copy_only=False)
                for g, r in np.unique(np.stack([group, at], axis=1), axis=0).tolist():
                    own = np.flatnonzero((group == g) & (at == r))
                    there, sums = summed(score[own], sides[own])
                    yield pa.record_batch([groups.dictionary.take(pa.array([g])), pa.array([r], pa.int32()), pa.array([len(own)]), pa.array([there.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], [by, "__range", "n", "score", "sides"])

    def wins(rows: pa.Table) -> pa.Table:
        score, sides = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("score", float), ("sides", np.int64)))
        _, sums = summed(score, sides.reshape(len(score), -1))
        pos, neg = sums[:, :width].astype(float), sums[:, width:].astype(float)
        won = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
        return pa.table({by: rows.column(by)[:1], "__range": rows.column("__range")[:1], "n": pa.array([pa.compute.sum(rows.column("n")).as_py()]), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("pos", pos.sum(axis=0)), ("neg", neg.sum(axis=0)), ("won", won))}})

    def ends(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__range")
        pos, neg, won = (np.frombuffer(b"".join(rows.column(c).to_pylist())).reshape(rows.num_rows, -1) for c in ("pos", "neg", "won"))
        won = (won + pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0)
        both = pos.sum(axis=0) * neg.sum(axis=0)
        aucs = np.where(both > 0, won / np.where(both > 0, both, 1.0), np.nan)
        drawn, chance = (v[~np.isnan(v)] for v in (aucs[1 : 1 + draws], aucs[1 + draws :]))
        tail = (1 - level) / 2
        p = (int((chance >= aucs[0] - 1e-12).sum()) + 1) / (len(chance) + 1) if len(chance) and not np.isnan(aucs[0]) and pa.compute.sum(rows.column("n")).as_py() >= 4 else None
        return pa.table({by: rows.column(by)[:1], **{c: pa.array([v], pa.float64()) for c, v in (("lo", _quantile(drawn.tolist(), tail)), ("hi", _quantile(drawn.tolist(), 1 - tail)), ("p", p))}})

    each = asked.mapInArrow(blocks, f"{kind}, n bigint, score binary, sides binary").groupBy(by, "__range").applyInArrow(wins, f"{kind}, n bigint, pos binary, neg binary, won binary")
    return each.groupBy(by).applyInArrow(ends, f"`{by}` {dict(scored.dtypes)[by]}, lo double, hi double, p double")  # a row for each range


def size_bands(values: DataFrame, size: str, ord_: str, bands: int = 5) -> DataFrame:
    """values with band: the rank by log1p of the size (negative ones count as 0, ties by ord) cut into equal parts."""
    sized = values.withColumn("__log", F.log1p(F.greatest(F.lit(0.0), F.col(size).cast("double"))))
    n = sized.count()
    ranked = row_number(sized, "__log", ord_, name="__rank")
    return ranked.withColumn("band", F.least(F.lit(bands - 1), F.floor((F.col("__rank") - 1) * bands / F.lit(max(n, 1)))).cast("int")).drop("__log", "__rank")


#: Hex digits of a hash that pairs are counted by.
DIGITS = 4


def pair_split(pairs: DataFrame, pair: str, dev_fraction: float, seed: str) -> DataFrame:
    """pairs (each once) with split: dev for the first round(n * fraction) (half to even, one at least, all but one at most) in the order of seeded hashes.

    The hash of the last of them is looked for by counts of the hashes' first digits, then among those of one beginning; nothing is ranked.
    """
    hashed = pairs.withColumn("__h", digest(seed, F.col(pair)))
    counts = {r["d"]: r["n"] for r in hashed.groupBy(F.substring("__h", 1, DIGITS).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 16 ** DIGITS at most
    n = sum(counts.values())
    left, last = max(1, min(n - 1, round(n * dev_fraction))), ""
    for beginning in sorted(counts):
        if left <= counts[beginning]:
            last = hashed.where(F.col("__h").startswith(beginning)).select("__h").orderBy("__h").limit(left).agg(F.max("__h").alias("h")).first()["h"]
            break
        left -= counts[beginning]
    return hashed.withColumn("split", F.when(F.col("__h") <= last, "dev").otherwise("eval")).drop("__h")


def midranks(scored: DataFrame, score: str) -> DataFrame:
    """Distinct scores with their count and average rank."""
    counts = scored.groupBy(score).agg(F.count("*").alias("n"))
    return running(counts, score, [], {"upto": F.col("n")}).select(score, "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("midrank"))


def rounded(c: Column | str, alias: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(alias or c)
