"""A generation store whose tables are bucketed and sorted by cache key.

Requests and layers have the same buckets, so a lookup joins bucket with bucket
and moves nothing; what an append moves is the appended rows alone, each to the
one task that writes its bucket's next file. Files appear when the job commits,
so a lost task or a failed append leaves no part of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """One table of the store: a folder of Parquet files, known to the session by a name of its own.

    Its key is never null and comes once; of equal keys in an append any one is kept, and keys that are held already stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "cache_key", buckets: int = 32):
        """Opens the folder, or makes it. schema, key and buckets must be those it was made with."""
        self.spark, self.key, self.buckets = spark, key, buckets
        self.name = "store_" + "".join(c if c.isalnum() else "_" for c in path.rstrip("/").split("//")[-1])[-80:]
        where = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds the rows whose keys aren't held. The deal to tasks is that of the buckets, so each task writes one file."""
        fresh = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(self.rows.select(self.key), self.key, "left_anti")
        dealt = fresh.select(*self.rows.columns).repartition(self.buckets, self.key)
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)


def lookup(requests: Store, layers: list[Store]) -> DataFrame:
    """Requests that a layer holds: their key, the number of the first such layer, and its row. Latency that is read is not trustworthy.

    All tables have one key and one number of buckets; layers have the same columns.
    """
    return _met(requests, layers).where("held is not null").select(requests.key, "held.*")


def missing(requests: Store, layers: list[Store]) -> DataFrame:
    """Requests that no layer holds, as they are."""
    return reduce(lambda df, layer: df.join(layer.rows.select(layer.key), requests.key, "left_anti"), layers, requests.rows)


def _met(requests: Store, layers: list[Store]) -> DataFrame:
    key = requests.key
    if any(s.buckets != requests.buckets or s.key != key for s in layers):
        raise ValueError("requests and layers need the same key and buckets")
    rest = [c for c in layers[0].rows.columns if c != key]
    value = lambda c: F.lit(False).alias(c) if c == "latency_trustworthy" else F.col(c)
    out = requests.rows.select(key)
    for i, layer in enumerate(layers):
        out = out.join(layer.rows.select(key, F.struct(F.lit(i).alias("layer"), *map(value, rest)).alias(f"l{i}")), key, "left")
    return out.select(key, F.coalesce(*(F.col(f"l{i}") for i in range(len(layers)))).alias("held"))
