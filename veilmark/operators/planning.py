"""Plans of work and their execution: units, batches by length, cached and fresh generations, deferred batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.errors import DeferredError
from veilmark.functions.identity import unit_id
from veilmark.operators import cache
from veilmark.operators.cache import THROUGHPUT
from veilmark.operators.ordering import row_number


def plan_units(probes: DataFrame, k: int, config: str, containment: str, backend: str) -> DataFrame:
    """One unit for each probe, with k samples, in the order of entity, family, probe."""
    own = unit_id(F.col("probe_id"), F.col("entity_id"), k, config, containment, backend)
    return probes.select("probe_id", "entity_id", "family", F.lit(k).alias("k"), own.alias("unit_id")).orderBy("entity_id", "family", "probe_id")


def batches(requests: DataFrame, size: int, shown: str = "shown", key: str = "cache_key") -> DataFrame:
    """requests with `batch`: so many at once, the shortest prompts first, ties by key, so that each batch pads to a like length."""
    sized = requests.withColumn("length", F.char_length(shown))
    ranked = row_number(sized, "length", key, name="place")
    return ranked.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("bigint")).drop("place", "length")


def run_batches(requests: DataFrame, generate: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame]:
    """(generations, units put off): a batch on which the backend runs out of memory makes nothing, and its units are left for later.

    requests: batch, unit_id and what `generate` needs; schema: of what it returns. Both results read one table, so each batch runs once.
    """
    from veilmark.operators.durable import durable

    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return generate(frame)[names].assign(put_off=None)
        except DeferredError:
            units = frame["unit_id"].drop_duplicates()
            return pd.DataFrame({**{n: [None] * len(units) for n in names}, "put_off": units.to_list()}).astype(object)

    made = durable(requests.groupBy("batch").applyInPandas(one, f"{schema}, put_off string"))
    return made.where("put_off is null").drop("put_off"), made.where("put_off is not null").select(F.col("put_off").alias("unit_id")).distinct()


def execute(requests: DataFrame, layers: list[DataFrame], generate: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int, write: Callable[[DataFrame], None], post: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(generations, units put off). What a layer holds is read, the rest made in batches and written to the last layer (`write`);
    caches hold raw generations, so the containment hook `post` runs over both."""
    held = cache.read_through(requests, layers).drop("layer")
    todo = batches(cache.missing(requests, layers), size)
    fresh, off = run_batches(todo, generate, schema)
    write(fresh)
    rest = [c for c in requests.columns if c != "cache_key" and c not in held.columns]
    both = held.unionByName(fresh.select(*(c for c in fresh.columns if c in held.columns)), allowMissingColumns=True)
    return post(both.join(requests.select("cache_key", *rest), "cache_key")), off


def estimate_text(generations: int, cached: int, tier: str = "stub") -> str:
    """What a plan takes, in words."""
    todo = max(0, generations - cached)
    seconds = todo / THROUGHPUT[tier]
    span = f"{seconds:.0f} s" if seconds < 120 else f"{seconds / 60:.1f} min" if seconds < 7200 else f"{seconds / 3600:.1f} h"
    return f"{todo:,} of {generations:,} generations to make, {cached:,} cached, about {span} on {tier}"
