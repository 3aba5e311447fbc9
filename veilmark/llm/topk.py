"""Exact inner-product search over buckets of vectors of like length.

Candidates are sorted by falling length and packed into buckets of `BUCKET`
vectors, queries into blocks of `BLOCK` by the length that a candidate needs at
least: their first threshold (the k-th best score among the longest candidates)
over their own length. Buckets fall into at most `SHELVES` shelves by length and
a salt, and a block meets, by an equality join, only shelves that are long
enough for it.

In a task, a query has a local cosine threshold for each bucket: its threshold
over its own length and the bucket's. Above 1 the bucket is skipped. From
`STEEP` on coordinates prune: a vector within the threshold's angle of the query
has each coordinate's angle within it of the query's, so the query's `FOCUS`
largest coordinates are looked at first. Below it lengths prune: the bucket's
vectors from the first too short one on are left out. What is left is verified
by integer products, and raises the thresholds of the block's next buckets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import Tables, release, small_batches
from veilmark.llm.vectors import dimension, floors, matrix, whole

#: Candidates of a bucket, queries of a block, longest candidates that give first thresholds.
BUCKET, BLOCK, SEED = 4096, 512, 1024
#: Shelves at most, coordinates looked at, cosine from which coordinates prune.
SHELVES, FOCUS, STEEP = 1024, 3, 0.8
#: Bounds are in doubles; this share of them is left to rounding.
SLACK = 1e-9
#: Blocks whose raised thresholds a task keeps; others begin with their first ones again.
KEPT = 1024
LEAST = -(1 << 63)
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def lengths_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers, by float64 where that is exact; beyond 64 bits it saturates."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, -LEAST - 1).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    near = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return near[np.lexsort((ids[near], ~scores[near]))[:k]]


def needed(least: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The length without which a candidate cannot reach a threshold; 0 if any can."""
    return np.where((least > 0) & (lengths > 0), least / np.where(lengths > 0, lengths, 1.0), 0.0) * (1 - SLACK)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in order, `size` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            rows = pa.Table.from_batches(held)
            full = rows.num_rows // size * size
            yield from (rows.slice(at, size).combine_chunks() for at in range(0, full, size))
            held = rows.slice(full).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()
    release()


def _rows(table: pa.Table, d: int) -> np.ndarray:
    return matrix(table.column("x").combine_chunks(), d) if table.num_rows else np.zeros((0, d), np.int64)


def _bucketed(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, BUCKET):
            yield pa.record_batch([pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), pa.array([_rows(t, d).tobytes()], pa.binary()), pa.array([t.column("length").to_numpy().max()])], ["ids", "rows", "longest"])

    return bucketed


def _thresholds(seed: pa.Table, d: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to queries the k-th best score among the seed's vectors without their own (LEAST if these are fewer), and the length that a candidate needs for it."""
    ids, rows = seed.column("id").to_numpy(), _rows(seed, d)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mine = matrix(batch.column("x"), d), batch.column("id").to_numpy()
            scores = np.where(ids[None, :] == mine[:, None], LEAST, exact(x, rows))
            least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(x), LEAST)
            yield pa.record_batch([batch.column("id"), batch.column("x"), pa.array(least), pa.array(needed(least, lengths_of(x)))], ["id", "x", "least", "need"])

    return thresholds


def _blocked(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, BLOCK):
            packed = [t.column("id").to_numpy(), _rows(t, d), t.column("least").to_numpy()]
            yield pa.record_batch([*(pa.array([c.tobytes()], pa.binary()) for c in packed), pa.array([t.column("need").to_numpy().min()])], ["q_ids", "q_rows", "q_least", "q_need"])

    return blocked


def survivors(q: np.ndarray, need: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of queries, places of candidates) of a bucket whose products can reach the queries' thresholds. need: see `needed`; lengths: the bucket's, the longest first."""
    longest = max(lengths[0], 1e-300)
    cosine = need / longest
    steep = np.flatnonzero((cosine >= STEEP) & (cosine <= 1))
    if len(steep):
        unit = q[steep] / np.maximum(lengths_of(q[steep]), 1e-300)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        angle, own = np.arccos(cosine[steep])[:, None], np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))
        high, low = np.cos(np.maximum(own - angle, 0)) + 1e-7, np.cos(np.minimum(own + angle, np.pi)) - 1e-7
        near = x / np.maximum(lengths, 1e-300)[:, None]
        keep = lengths[None, :] >= need[steep][:, None]
        for f in range(focus.shape[1]):
            at = near[:, focus[:, f]].T
            keep = keep & (at >= low[:, f : f + 1]) & (at <= high[:, f : f + 1])
        for i in np.flatnonzero(keep.any(axis=1)):
            yield steep[i : i + 1], np.flatnonzero(keep[i])
    flat = np.flatnonzero(cosine < STEEP)
    if len(flat):
        yield flat, np.arange(np.searchsorted(-lengths, -need[flat].min(), side="right"))


def _verified(d: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, bucket) pairs to those products that may be among a query's k best."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raised: OrderedDict[bytes, np.ndarray] = OrderedDict()  # block -> each query's k best scores so far
        for batch in batches:
            for row in batch.to_pylist():
                mine, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, x = np.frombuffer(row["q_rows"], np.int64).reshape(-1, d), np.frombuffer(row["rows"], np.int64).reshape(-1, d)
                tops = raised.pop(row["q_ids"], np.full((len(mine), k), LEAST))
                least = np.maximum(np.frombuffer(row["q_least"], np.int64), tops[:, 0])
                out = []
                for some, near in survivors(q, needed(least, lengths_of(q)), x, lengths_of(x)):
                    scores = exact(q[some], x[near])
                    for i, at in enumerate(some):
                        good = np.flatnonzero((scores[i] >= least[at]) & (ids[near] != mine[at]))
                        if len(good):
                            good = good[best(ids[near[good]], scores[i][good], k)]
                            tops[at] = np.sort(np.concatenate([tops[at], scores[i][good]]))[-k:]
                            out.append((np.full(len(good), mine[at]), ids[near[good]], scores[i][good]))
                raised[row["q_ids"]] = tops
                if len(raised) > KEPT:
                    raised.popitem(last=False)
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])
        release()

    return verified


def _parts(rows: int, size: int, cores: int) -> int:
    """Partitions for rows that are packed by size: one for each pack, or for 64 of them where there are many."""
    packs = -(-rows // size)
    return max(1, min(packs, 4 * cores + packs // 64))


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vec: str = "embedding", scale: int = 256, k: int = 5) -> DataFrame:
    """The k highest inner products of each query with all other vectors: query_id, rank (int, from 1), vec_id, score (bigint).

    queries: a condition that says which rows ask. An entry c counts as
    floor(scale * c), saturating at 2^62, a product saturates at 64 bits. Ties
    go to the smaller id; a query with fewer than k others has them all. Null
    vectors, those with null, NaN or infinite entries or of another length than
    most (the larger length in a tie), empty ones and those without an id take no
    part. Ids must cast to bigint; of rows that share an id one counts, that with
    the largest vector in the order of arrays, and it asks if any of them does.
    Without vectors or queries the result is empty. Other columns play no part.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = vectors.where(whole(vec) & F.col(vec_id).isNotNull())
    d = dimension(kept, vec)
    if not d:
        return spark.createDataFrame([], RESULT)
    rows = kept.where(F.size(vec) == d).select(F.col(vec_id).cast("bigint").alias("id"), floors(vec, scale).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    cores = spark.sparkContext.defaultParallelism
    tables = Tables(spark)  # of the plan that is returned: they go with spark.checkpoint.dir
    stored = tables.put(rows.groupBy("id").agg(F.max("x").alias("x"), F.max("asks").alias("asks")).withColumn("length", length))
    n, asking = stored.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    if not asking:
        return spark.createDataFrame([], RESULT)
    packed = stored.select("id", "x", "length").repartitionByRange(_parts(n, BUCKET, cores), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    buckets = tables.put(packed.mapInArrow(_bucketed(d), "ids binary, rows binary, longest double"))
    seed = stored.select("id", "x", "length").orderBy(F.desc("length"), "id").limit(SEED).select("id", "x").toArrow()
    asked = tables.put(stored.where("asks").select("id", "x").mapInArrow(_thresholds(seed, d, k), "id bigint, x array<bigint>, least bigint, need double"))
    blocks = asked.repartitionByRange(_parts(asking, BLOCK, cores), "need", "id").sortWithinPartitions("need", "id").mapInArrow(_blocked(d), "q_ids binary, q_rows binary, q_least binary, q_need double")

    count, edges = buckets.agg(F.count(F.lit(1)), F.percentile_approx("longest", [i / SHELVES for i in range(SHELVES + 1)], 10 * SHELVES)).first()
    edges = sorted(set(edges))
    over = lambda c: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > c))  # noqa: E731  edges are few and rows are buckets or blocks
    salts = min(-(-count // len(edges)), -(-SHELVES // len(edges)))
    shelved = buckets.withColumns({"shelf": over(F.col("longest")), "salt": F.pmod(F.xxhash64("ids"), F.lit(salts))}).drop("longest")
    meeting = blocks.withColumn("shelf", F.explode(F.sequence(F.lit(0), over(F.col("q_need"))))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))).drop("q_need")
    cells = meeting.hint("merge").join(shelved, ["shelf", "salt"]).select("q_ids", "q_rows", "q_least", "ids", "rows")
    found = cells.mapInArrow(_verified(d, k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
