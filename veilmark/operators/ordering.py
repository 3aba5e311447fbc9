"""Ranks and running sums over a whole table without gathering it in one task.

Rows are cut into at most `CUTS` + 1 ranges of the leading numeric key by
approximate quantiles (one aggregate, a bounded array). A window runs inside
each range, and the totals of the ranges before are added; a range is as large
as its share of the rows, or of the rows of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS, STEP = 255, 16


def cuts(df: DataFrame, key: str) -> list[float]:
    """Where the ranges of a key end."""
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000).alias("c")).first()["c"]
    return sorted(set(found or []))


def range_of(edges: list[float], key: Column) -> Column:
    """How many edges are below the key: of every `STEP`-th first, then of those up to the next such."""
    ends = lambda some: F.split(F.lit(" ".join(map(repr, some))), " ").cast("array<double>") if some else F.array().cast("array<double>")  # noqa: E731  (one literal, once it is folded)
    below = lambda some, k: F.size(F.filter(some, lambda c: c < k))
    whole, parts = ends(edges[STEP - 1 :: STEP]), F.array(*(ends(edges[i : i + STEP - 1]) for i in range(0, len(edges) + 1, STEP)))
    # Lambdas' arguments are computed once.
    found = F.transform(F.array(key), lambda k: F.transform(F.array(below(whole, k)), lambda n: n * STEP + below(F.get(parts, n), k))[0])
    return found[0]


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), edges: list[float] | None = None) -> DataFrame:
    """df with, for each name in sums, the sum of its column over this row and all before it in the order that key leads; null keys come first.

    by: columns (not null) whose groups have sums of their own. edges: where ranges end, if they are known from `cuts`.
    """
    edges = cuts(df, key) if edges is None else edges
    ranged = df.withColumn("__range", range_of(edges, F.col(key).cast("double")))
    ranged = ranged.withColumns({f"__{n}": c for n, c in sums.items()})
    totals = ranged.groupBy("__range", *by).agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    before = (Window.partitionBy(*by) if by else Window).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # of CUTS + 2 rows at most
    offsets = totals.select("__range", *by, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums))
    inside = Window.partitionBy("__range", *by).orderBy(F.col(key).asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums}).join(offsets if by else F.broadcast(offsets), ["__range", *by])
    return out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums}).drop("__range", *(f"__{n}" for n in sums), *(f"__before_{n}" for n in sums))


def row_number(df: DataFrame, key: str, *order: str, name: str = "rank") -> DataFrame:
    """df with its rank, from 1, in the order of key, then order. Text keys are ranked by their hashes, then by themselves: an order, if not the alphabet's."""
    one = {name: F.lit(1).cast("bigint")}
    if dict(df.dtypes)[key] == "string":
        return running(df.withColumn("__hash", F.xxhash64(key)), "__hash", [F.col(c) for c in (key, *order)], one).drop("__hash")
    return running(df, key, [F.col(c) for c in order], one)
