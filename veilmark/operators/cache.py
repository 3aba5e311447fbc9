"""A layered generation cache as tables: first layer wins, what is missing is planned, budgets are guarded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.errors import BudgetExceeded

# Generations a second that the planner assumes.
THROUGHPUT = {"stub": 4000.0, "tiny": 1.2, "small": 12.0, "large": 4.0}


def read_through(requests: DataFrame, layers: list[DataFrame], key: str = "cache_key") -> DataFrame:
    """Requests that a layer holds, with the first such layer's row and its number; latency read from a cache is not trustworthy.

    Layers are one union keyed by the request, so more layers mean no more joins.
    """
    tagged = [layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(layers)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    asked = every.join(requests.select(key).distinct(), key, "left_semi")
    rest = [c for c in every.columns if c not in (key, "layer")]
    first = asked.groupBy(key).agg(F.min_by(F.struct("layer", *rest), "layer").alias("r")).select(key, "r.*")
    return first.withColumn("latency_trustworthy", F.lit(False)) if "latency_trustworthy" in rest else first


def missing(requests: DataFrame, layers: list[DataFrame], key: str = "cache_key") -> DataFrame:
    """Requests that no layer holds."""
    held = reduce(lambda a, b: a.union(b), [layer.select(key) for layer in layers])
    return requests.join(held, key, "left_anti")


def corrupt(layer: DataFrame, key: str, expected: Column | str) -> DataFrame:
    """Rows of a layer whose key is not what their content says."""
    return layer.where(~F.col(key).eqNullSafe(F.col(expected) if isinstance(expected, str) else expected))


def plan_budget(units: DataFrame, cached: DataFrame | None = None, tier: str = "stub") -> DataFrame:
    """One row: prompts, generations, cached, to_generate, projected_seconds. units: unit_id, k. cached: one row for each generation that is held."""
    total = units.agg(F.count("*").alias("prompts"), F.coalesce(F.sum("k"), F.lit(0)).alias("generations"))
    held = cached.agg(F.count("*").alias("cached")) if cached is not None else units.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("cached"))
    both = total.crossJoin(F.broadcast(held))
    todo = F.greatest(F.lit(0), F.col("generations") - F.col("cached"))
    return both.select("prompts", "generations", "cached", todo.alias("to_generate"), (todo / THROUGHPUT[tier]).alias("projected_seconds"))


def check_budget(budget: DataFrame, limit: int, confirmed: bool = False) -> None:
    """Raises unless the plan fits or was confirmed."""
    todo = budget.first()["to_generate"]
    if todo > limit and not confirmed:
        raise BudgetExceeded(f"{todo} generations are to be made, {limit} are allowed")


def pending(units: DataFrame, done: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units that no checkpoint marks as done."""
    return units.join(done.select(key).distinct(), key, "left_anti")
