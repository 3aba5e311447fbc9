"""What the operators share: reading, folds, durable tables, byte-balanced Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the JVM hands to Python at once; the rest of the batching is by bytes.
ARROW_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(0).cast("bigint"))


def small_batches(spark: SparkSession) -> None:
    """Keeps long texts from piling up in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _checkpoints(spark: SparkSession) -> None:
    """Sees to it that there is a checkpoint folder: the cluster's, or on one machine a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder, so that a lost executor loses none of them."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path inside the shared checkpoint folder."""
    _checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Parquet tables in the shared folder, smaller than checkpoints, that go when the block ends: nothing lazy may outlive it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def put(self, df: DataFrame) -> DataFrame:
        """The same rows, written and read again."""
        path = shared_folder(self.spark)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """One such table."""
    with Tables(df.sparkSession) as tables:
        yield tables.put(df)


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Each key sets three bits of a filter, from these places of its own.
_SHIFTS = (0, 19, 38)


def bitmap(keys: DataFrame, count: int, most: int) -> np.ndarray:
    """A Bloom filter of the table's only column (bigint fingerprints): some 32 bits for each of `count` keys, so that of a thousand others one passes, but at most `most` bits in all, as 64-bit words. Past that it lets more through, never less."""
    size = 1 << min(most.bit_length() - 1, max(16, (32 * max(count, 1) - 1).bit_length()))
    key = F.col(keys.columns[0])
    bits = keys.select(F.explode(F.array(*(F.pmod(F.shiftrightunsigned(key, s), F.lit(size).cast("bigint")) for s in _SHIFTS))).alias("bit"))
    rows = bits.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("b")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return words.view(np.uint64)


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64 bits, unsigned) the filter lets through."""
    out = np.ones(len(keys), bool)
    for s in _SHIFTS:
        at = keys >> np.uint64(s) & np.uint64(len(words) * 64 - 1)
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def release() -> None:
    """Gives a worker's free memory back to the system, for it is kept for the next task and shares a node with its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Regroups rows so that each batch holds about `most` bytes of a string or binary column, one row at least."""
    try:
        yield from _by_bytes(batches, column, most)
    finally:
        release()


def _by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lens):
            if size and size + n > most:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield joined(held)
                held, size, start = [], 0, i
            size += int(n)
        if len(lens) > start:
            held.append(batch.slice(start))
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0] if table.num_rows else batches[0]


def schema_of(df: DataFrame, *extra: tuple[str, str]) -> str:
    """DDL of the frame's columns, then the extra ones."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {t}" for n, t in extra)])


def running(values: Column) -> Column:
    """The sum of the values (bigint) before each one of an array, by blocks, so that long arrays cost little more than short ones."""
    values = F.transform(values, lambda v: v.cast("bigint"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / 64).cast("int")), lambda i: F.slice(values, i * 64 + 1, 64))
    add = lambda a, b: a + b
    zero = F.lit(0).cast("bigint")

    def ahead(s: Column, block: Column) -> Column:
        before = F.transform(block, lambda _, i: s["at"] + F.aggregate(F.slice(block, F.lit(1), i), zero, add))
        return F.struct((s["at"] + F.aggregate(block, zero, add)).alias("at"), F.concat(s["out"], F.array(before)).alias("out"))

    start = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.when(F.size(values) > 0, F.flatten(F.aggregate(blocks, start, ahead, lambda s: s["out"]))).otherwise(F.array().cast("array<bigint>"))
