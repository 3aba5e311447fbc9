"""Leak and uncertainty measures as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leak_at_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that k of n samples, c of which leak, show a leak: 1 - C(n-c, k) / C(n, k). Null if k exceeds n."""
    clean = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * F.greatest(n - c - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    value = F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(F.lit(1.0) - clean)
    return F.when((k > n) | (k < 1), F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def residual_entropy(logprobs: Column) -> Column:
    """Entropy in nats of the listed probabilities and what they leave; null if they add up to nothing."""
    p = F.transform(logprobs, F.exp)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - total)
    term = lambda x: F.when(x > 1e-12, -x * F.ln(x)).otherwise(0.0)
    return F.when(total > 0, F.aggregate(p, F.lit(0.0), lambda a, x: a + term(x)) + F.when(rest > 1e-9, term(rest)).otherwise(0.0))


def mean_of(values: Column) -> Column:
    """Mean of an array; null if it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def confidence_gap(logprobs: Column) -> Column:
    """Mean of the second half less that of the first, of four tokens or more."""
    half = F.floor(F.size(logprobs) / 2).cast("int")
    return F.when(F.size(logprobs) >= 4, mean_of(F.slice(logprobs, half + 1, F.size(logprobs))) - mean_of(F.slice(logprobs, F.lit(1), half)))


def resolvable_auc(pairs: Column) -> Column:
    """The smallest AUC that so many pairs can tell from chance."""
    return F.lit(0.5) + 1.96 * F.sqrt(F.lit(2.0) / 12 / F.greatest(pairs, F.lit(1)))


def detectability_state(lo: Column, hi: Column, threshold: float = 0.6) -> Column:
    return F.when(lo > 0.5, "detectable").when(hi <= threshold, "undetectable").otherwise("inconclusive")
