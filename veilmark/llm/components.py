"""Connected components of an edge table by alternating large and small stars, with a written table after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import Tables, durable


def _smallest(pairs: DataFrame) -> DataFrame:
    """u, and the smallest of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). Returns node, component (the smallest node of it) for every node of an edge."""
    with Tables(edges.sparkSession) as tables:
        state = tables.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        while True:
            # Done when each node hangs on one other that hangs on none.
            inner = state.join(state.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
            if not inner and not state.groupBy("u").count().where("count > 1").limit(1).count():
                break
            # Large star: every neighbour above u hangs on the smallest node that u knows.
            both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = tables.put(both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            # Small star: u and its neighbours below it hang on the smallest of them.
            least = _smallest(large)
            hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            state = tables.put(hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        return durable(state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
