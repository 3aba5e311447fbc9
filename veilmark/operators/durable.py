"""Tables that outlive lost executors and cut the plan behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder: spark.checkpoint.dir, or on one machine, where it is unset, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared checkpoint folder and read again; they stay there, for plans are read lazily."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as run at once, for small tables that much is computed from: by keys, or in turn."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


class Scratch:
    """Such tables that go when the block ends, for loops that read their own results: nothing lazy may outlive it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def put(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_path(self.spark))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])
