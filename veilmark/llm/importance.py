"""Importance resampling towards a target distribution of hashed word runs.

Runs of one to three words are counted by bucket on both sides, `BUCKETS` sums
a task. A bucket's gain is an entry of an array of `BUCKETS` numbers, so a
document's weight is a sum of looked-up entries, and Gumbel noise from a hash of
its id makes the highest scores a draw without replacement.

The exact k-th highest (score, id) is found by radix selection: the digits of
the key are fixed from the highest on, each by one count of `1 << DIGIT` sums of
those rows that share the digits before. Only rows that reach that key are
sorted, by ranges, and ranked; the others go to the result as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import Tables, by_bytes, release, schema_of, small_batches, spare

#: Hash buckets of the word runs; bits of a digit; bytes of text in a batch; bytes from which a word is hashed by itself.
BUCKETS, DIGIT, BATCH, LONG = 10_000, 12, 4 << 20, 64
#: Drawn rows of a range.
ROWS = 250_000
_BYTES = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTES = np.where(_BYTES & 1, (_BYTES >> 1) ^ np.uint32(0xEDB88320), _BYTES >> 1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, with the start, the length and the text's place of each word."""
    texts = pa.compute.fill_null(texts, "")
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(t.as_buffer() for t in texts), np.uint8)
    data = _LOWER[raw]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    ends_of_texts = np.cumsum(sizes)
    first = np.zeros(len(data) + 1, bool)
    first[(ends_of_texts - sizes)] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    breaks = np.flatnonzero(before & (~inside | first))
    return data, starts, breaks - starts, np.searchsorted(ends_of_texts, starts, side="right")


def _onward(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC states (not yet inverted) after each state's word."""
    state = state.copy()
    at = np.flatnonzero(lengths <= LONG)
    for k in range(int(lengths[at].max(initial=0))):
        at = at[lengths[at] > k]
        s = state[at]
        state[at] = _BYTES[(s ^ data[starts[at] + k]) & 255] ^ (s >> 8)
    for i in np.flatnonzero(lengths > LONG):
        state[i] = ~np.uint32(zlib.crc32(data[starts[i] : starts[i] + lengths[i]], int(~state[i] & 0xFFFFFFFF)))
    return state


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's place and the bucket of each run of 1 to 3 words, and the words of each text."""
    data, starts, lengths, text = _words(texts)
    state = _onward(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    places, buckets = [text], [~state % BUCKETS]
    for run in (2, 3):
        state = state[:-1]
        last = slice(run - 1, None)
        state = _BYTES[(state ^ 32) & 255] ^ (state >> 8)
        state = _onward(state, data, starts[last], lengths[last])
        same = text[: len(state)] == text[last]
        places.append(text[last][same]), buckets.append((~state % BUCKETS)[same])
    return np.concatenate(places), np.concatenate(buckets).astype(np.int64), np.bincount(text, minlength=len(texts))


def counts(texts: DataFrame, text: str) -> dict[int, int]:
    """How often each bucket occurs in all texts; buckets that don't are left out."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in by_bytes(batches, "text", BATCH):
            total += np.bincount(features(batch.column("text"))[1], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], ["bucket", "n"])
        release()

    small_batches(texts.sparkSession)
    return dict(texts.select(F.col(text).alias("text")).mapInArrow(tasks, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect())


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one added to every count."""
    s, t = (np.array([side.get(b, 0) for b in range(BUCKETS)], np.float64) for side in (source, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, table: np.ndarray, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_features and weight (the sum of the runs' gains)."""
    out = [c for c in docs.columns if c not in (text, "n_words", "n_features", "weight")]
    at = spare(docs, "text")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at, BATCH):
            places, buckets, words = features(batch.column(at))
            sums = np.bincount(places, weights=table[buckets], minlength=batch.num_rows)  # of doubles far below 2^53
            more = [words, np.bincount(places, minlength=batch.num_rows), sums]
            yield pa.record_batch([*(batch.column(c) for c in out), *(pa.array(m.astype(np.int64)) for m in more)], [*out, "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{c}`") for c in out), F.col(text).alias(at))
    return rows.mapInArrow(weighed, schema_of(rows.select(*(f"`{c}`" for c in out)), ("n_words", "bigint"), ("n_features", "bigint"), ("weight", "bigint")))


def gumbel(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(seed:id); a null id hashes as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _place(number: int) -> int:
    """A bigint's place among all bigints, from 0."""
    return number + (1 << 63)


def kth(rows: DataFrame, falling: str, rising: str, k: int) -> tuple[int, int] | None:
    """The k-th row's two keys (bigint, not null) in the order of the falling, then the rising one; none without a k-th row."""
    where, left, found = F.lit(True), k, []
    for key, sign in ((falling, -1), (rising, 1)):
        n, low, high = rows.where(where).agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
        if not 0 < left <= n:
            return None
        place = F.col(key).bitwiseXOR(F.lit(-1 << 63)) if sign > 0 else F.bitwise_not(F.col(key).bitwiseXOR(F.lit(-1 << 63)))
        ends = (_place(low), _place(high)) if sign > 0 else ((1 << 64) - 1 - _place(high), (1 << 64) - 1 - _place(low))
        at, left = _select(rows.where(where), place, *ends, left)
        found.append(at - (1 << 63) if sign > 0 else (1 << 63) - 1 - at)
        where = where & (F.col(key) == found[-1])
    return found[0], found[1]


def _select(rows: DataFrame, place: Column, low: int, high: int, k: int) -> tuple[int, int]:
    """The k-th smallest place (64 bits, unsigned) of places from low to high, and which of the rows at it is the k-th."""
    shift = (low ^ high).bit_length()
    prefix = high >> shift
    while shift:
        above = shift
        shift = max(0, shift - DIGIT)
        same = F.shiftrightunsigned(place, above) == F.lit(prefix) if above < 64 else F.lit(True)
        digit = F.shiftrightunsigned(place, shift).bitwiseAND(F.lit((1 << (above - shift)) - 1).cast("bigint"))
        for d, n in sorted(rows.where(same).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if k <= n:
                prefix = prefix << (above - shift) | d
                break
            k -= n
    return prefix, k


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42) -> DataFrame:
    """docs without the text, with n_words, n_features, weight, score (bigint) and rank (bigint: 1 for the first one drawn, null if not drawn).

    Of the documents with least_words words or more, floor(share) are drawn:
    those with the highest scores, ties to the smaller id. A null or empty text
    has no words and weighs 0. Ids must be integers; a null id hashes as an empty
    one and comes last in a tie. Repeated rows are rows of their own with the
    same score; if the last place falls among them, as many as fit are drawn.
    Texts of any length count whole, an empty target leaves every gain to the
    source's counts, and without documents the result is empty. Other columns
    stay; those named like the new ones are replaced.
    """
    spark = docs.sparkSession
    table = gains(counts(docs, text), counts(target, target_text))
    tables = Tables(spark)  # of the plan that is returned: they go with spark.checkpoint.dir
    scored = weigh(docs.drop("score", "rank"), table, text).withColumn("score", F.col("weight") + gumbel(doc_id, seed))
    order = spare(scored, "order")
    rows = tables.put(scored.withColumn(order, F.coalesce(F.col(doc_id).cast("bigint"), F.lit((1 << 63) - 1))))
    able = F.col("n_words") >= least_words
    k = rows.where(able).count() * share[0] // share[1]
    last = kth(rows.where(able), "score", order, k)
    if last is None:
        return rows.drop(order).withColumn("rank", F.lit(None).cast("bigint"))
    reached = able & ((F.col("score") > last[0]) | (F.col("score") == last[0]) & (F.col(order) <= last[1]))
    keys, at = [F.desc("score"), F.asc(order)], spare(rows, "at")
    ranged = rows.where(reached).repartitionByRange(1 + k // ROWS, *keys).sortWithinPartitions(*keys, "n_features", "weight").withColumn(at, F.monotonically_increasing_id())
    drawn = tables.put(ranged)
    part, inside = F.shiftrightunsigned(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    sizes = dict(drawn.groupBy(part.alias("part")).agg(F.max(inside)).collect())
    before = [0]
    for i in range(max(sizes) + 1):
        before.append(before[-1] + sizes.get(i, 0))
    rank = F.element_at(F.array(*(F.lit(b).cast("bigint") for b in before)), (part + 1).cast("int")) + inside
    ranked = drawn.withColumn("rank", F.when(rank <= k, rank)).drop(at)
    return ranked.unionByName(rows.where(~reached).withColumn("rank", F.lit(None).cast("bigint"))).drop(order)
