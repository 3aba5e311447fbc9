"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; it hashes the positions marked
1 and ignores those marked 0, so a window still hits after tokens at ignored
positions were substituted. Test items are hashed under all masks, and so is
every window of every document; equal hashes are joined. All hits of a document
and an item on one diagonal are one: its tokens are compared along the diagonal,
and from each hit that no run holds yet the best run of matches (+1 each) and
substitutions (-penalty each) grows in both directions. A run counts if it is at
least `least` tokens long with `identity` of them equal.

Tokens are runs of letters and digits of the lower-cased text. An item shorter
than `least` tokens must be found whole, with that identity; one too short for
any mask has one seed, all of its tokens, and must be found word for word.

Documents meet a filter of the items' hashes first (sized by their number, up to
`FILTER_BITS`; beyond, it lets more through); what passes is written with the
tokens around it, so no text is read twice, and joined with the items' hashes as
tables, so the items may outgrow any broadcast. Passing windows that lie within
the longest item's length of one another share one stretch of tokens.

Nulls: a null text has no tokens; null ids of documents and items are compared
like others, and grouped as one id. Ids may be of any type that can be grouped.
Copies, repeated rows and repeated ids hit one by one and are counted once per
distinct run. Ties between runs of an item go to the earliest. Very long
texts and items are cut into windows whole. Empty tables give no rows. Other
columns are left out by `overlaps`; `clean` keeps all of them, and judges each
row by its own text, also where rows share an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import Tables, bitmap, by_bytes, durable, passes, small_batches, spare
from veilmark.llm.tokens import NOT_ALNUM, mix, word_hashes

#: Fixed masks: weight 6 within 8 or 9 tokens.
MASKS = ("11111100", "110110110", "111010011", "101101011")
LEAST = 10
IDENTITY = 0.8
PENALTY = 2.0
FILTER_BITS = 1 << 26
BATCH_BYTES = 1 << 20
#: Rows of 8 bytes up to which `clean` sends the contaminated rows' fingerprints to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_U = np.uint64


def seeds(words: np.ndarray, first: np.ndarray, masks: tuple[str, ...], short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start position in words, hash) of all windows inside one text, for each mask and then for each short length; a text shorter than a mask's span gives none for it."""
    last = np.repeat(first[1:], np.diff(first))
    for m, mask in enumerate([*masks, *("1" * n for n in short)]):
        mask = mask.rstrip("0")
        at = np.arange(len(words))
        at = at[at + len(mask) <= last]
        h = np.full(len(at), m + 1 if m < len(masks) else 1000 + len(mask), _U)
        for k, c in enumerate(mask):
            if c == "1":
                h = (h ^ words[at + k]) * _U(0x9E3779B97F4A7C15)
                h ^= h >> _U(29)
        yield at, mix(h)


def _item_rows(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, words, hashes, ats): each distinct item by a fingerprint of its id and tokens, its tokens and seeds."""
    shortest = min(len(m.rstrip("0")) for m in masks)
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        words, first = word_hashes(batch.column("text").to_pylist(), NOT_ALNUM)
        rows = []
        for a, b in zip(first, first[1:]):
            own, few = words[a:b], b - a < shortest
            found = list(seeds(own, np.array([0, len(own)]), () if few else masks, (len(own),) if few and len(own) else ()))
            rows.append((own.tobytes(), *(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (1, 0))))
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1].view(np.int64).tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))], ["item", "item_id", "words", "hashes", "ats"])


def _stretches(batches: Iterator[pa.RecordBatch], bits: np.ndarray, masks: tuple[str, ...], short: tuple[int, ...], reach: int) -> Iterator[pa.RecordBatch]:
    """(key, stretch, doc_from, words, hashes, ats): windows that pass the filter, by stretches of tokens that hold all within reach of them."""
    from pyspark import TaskContext

    task, k = TaskContext.get().partitionId(), 0
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        words, first = word_hashes(batch.column("text").to_pylist(), NOT_ALNUM)
        found = [(at[ok], h[ok]) for at, h in seeds(words, first, masks, short) if len(ok := np.flatnonzero(passes(bits, h)))]
        if not found:
            continue
        at, h = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
        own = np.searchsorted(first, at, side="right") - 1
        cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] - at[:-1] > 2 * reach))))
        ends = np.concatenate((cut[1:], [len(at)]))
        low = np.maximum(at[cut] - reach, first[own[cut]])
        high = np.minimum(at[ends - 1] + reach, first[own[cut] + 1])
        ids = (task << 40) + k + np.arange(len(cut))
        k += len(cut)
        offsets = pa.array(np.concatenate((cut, [len(at)])).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(own[cut])), pa.array(ids), pa.array(low - first[own[cut]]), pa.array([words[a:b].tobytes() for a, b in zip(low, high)], pa.binary()),
             pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(at - np.repeat(low, ends - cut)))],
            ["key", "stretch", "doc_from", "words", "hashes", "ats"],
        )


def best_run(equal: np.ndarray, at: int, penalty: float) -> tuple[int, int]:
    """The best-scoring run around position at: it grows in both directions to where the score is highest."""
    step = np.where(equal, 1.0, -penalty)
    right, left = np.cumsum(step[at:]), np.cumsum(step[:at][::-1])
    end = at + 1 + int(right.argmax())
    start = at - (1 + int(left.argmax()) if len(left) and left.max() > 0 else 0)
    return start, end


def _extended(batches: Iterator[pa.RecordBatch], least: int, identity: float, penalty: float) -> Iterator[pa.RecordBatch]:
    """(key, item_id, doc_start, doc_end, equal): the runs of each diagonal that are long and alike enough."""
    for batch in batches:
        rows: list[int] = []
        out: list[tuple[int, int, int]] = []
        columns = (batch.column(c).to_pylist() for c in ("shift", "ats", "doc_from", "doc", "item"))
        for row, (shift, ats, doc_from, doc, item) in enumerate(zip(*columns, strict=True)):
            d, t = np.frombuffer(doc, _U), np.frombuffer(item, _U)
            low, high = max(0, shift), min(len(d), len(t) + shift)  # shift: the item's start in the stretch
            equal = d[low:high] == t[low - shift : high - shift]
            end = -1
            for at in sorted(ats):
                if at - low < end:
                    continue
                start, end = best_run(equal, at - low, penalty)
                same = int(equal[start:end].sum())
                if end - start >= min(least, len(t)) and same >= identity * (end - start):
                    rows.append(row)
                    out.append((doc_from + low + start, doc_from + low + end, same))
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("item_id").take(at), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], ["key", "item_id", "doc_start", "doc_end", "equal"])


def runs(docs: DataFrame, items: DataFrame, tables: Tables, masks: tuple[str, ...] = MASKS, least: int = LEAST, identity: float = IDENTITY, penalty: float = PENALTY) -> DataFrame:
    """docs: key, text. items: item_id, text. Returns key, item_id, doc_start, doc_end, equal: all overlaps. Valid as long as the tables are."""
    spark = docs.sparkSession
    small_batches(spark)
    key, item_id = docs.schema["key"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    texts = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.lower("text").cast("binary").alias("text")).dropDuplicates(["item"])
    items = tables.put(texts.mapInArrow(lambda b: _item_rows(b, masks), f"item bigint, item_id {item_id}, words binary, hashes array<bigint>, ats array<bigint>"))
    test = items.select("item", F.explode(F.arrays_zip("hashes", "ats")).alias("s")).select("item", F.col("s.hashes").alias("hash"), F.col("s.ats").alias("item_at"))
    size = items.agg(F.max(F.octet_length("words")), F.sum(F.size("hashes"))).first()
    reach, n = (size[0] or 0) // 8, size[1] or 0
    shortest = min(len(m.rstrip("0")) for m in masks)
    short = tuple(sorted(r[0] // 8 for r in items.where(F.octet_length("words").between(8, 8 * shortest - 1)).select(F.octet_length("words")).distinct().collect()))  # fewer than a mask's tokens
    bits = spark.sparkContext.broadcast(bitmap(test.select("hash"), n, FILTER_BITS))
    found = tables.put(docs.select("key", F.lower("text").cast("binary").alias("text")).mapInArrow(lambda b: _stretches(b, bits.value, masks, short, reach), f"key {key}, stretch bigint, doc_from bigint, words binary, hashes array<bigint>, ats array<bigint>"))
    windows = found.select("stretch", F.explode(F.arrays_zip("hashes", "ats")).alias("s")).select("stretch", F.col("s.hashes").alias("hash"), F.col("s.ats").alias("at"))
    hits = windows.join(test, "hash").groupBy("stretch", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("at").alias("ats"))
    met = hits.join(found.select("stretch", "key", "doc_from", F.col("words").alias("doc")), "stretch").join(items.select(F.col("item").alias("item_no"), "item_id", F.col("words").alias("item")).withColumnRenamed("item", "item_words"), F.col("item") == F.col("item_no"))
    return met.select("key", "shift", "ats", "doc_from", "doc", "item_id", F.col("item_words").alias("item")).mapInArrow(lambda b: _extended(b, least, identity, penalty), f"key {key}, item_id {item_id}, doc_start bigint, doc_end bigint, equal bigint")


def overlaps(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, n_overlaps, longest (tokens), equal (of the longest), doc_start (its first token)."""
    length = F.col("doc_end") - F.col("doc_start")
    best = F.struct(length, F.col("equal"), -F.col("doc_start"))
    with Tables(docs.sparkSession) as tables:
        found = runs(docs.select(F.col("doc_id").alias("key"), "text"), items, tables, **how).withColumnRenamed("key", "doc_id")
        return durable(found.groupBy("doc_id", "item_id").agg(F.count_distinct("doc_start", "doc_end").alias("n_overlaps"), F.max(length).alias("longest"), F.max_by("equal", best).alias("equal"), F.max_by("doc_start", best).alias("doc_start")))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs that overlap with no item, with all their columns."""
    mark = spare(docs, "mark")
    own = F.xxhash64("doc_id", "text")
    with Tables(docs.sparkSession) as tables:
        bad = durable(runs(docs.select(own.alias("key"), "text"), items, tables, **how).select(F.col("key").alias(mark)).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.withColumn(mark, own).join(bad, mark, "left_anti").select(*docs.columns)
