"""Language-model scores by deleted interpolation.

Tokens are words, lower-cased in A-Z, and one end after each text. A token's
probability mixes maximum-likelihood estimates of n-grams up to `order` with a
uniform one over the training types and one more:

    p = w0 / (V + 1) + w1 c(t) / N + w2 c(h t) / c(h) + ...

The weights depend on the context's frequency: a bucket for each power of two
of c(h) (of the shortest context), unseen contexts in a bucket of their own.
They are learnt by expectation-maximisation on held-out counts: the documents
of the `tune` fold are left out of the counts (deleted) and predicted from the
rest. The final counts hold all training documents, the tune fold too.

How counts travel. A task turns about `BATCH_BYTES` of text into one durable
row: types, token stream, ids. Each batch then asks for the counts of its own
distinct n-grams: their 64-bit fingerprints, sorted, as differences, go packed to
`shards` by their high bits, each with the batch's own counts; a shard adds up its fingerprints and answers each
batch in the batch's order. So all training tokens are counted, nothing is
held by one machine, a frequent n-gram comes once a batch, and the rows moved
are at most the distinct n-grams of each batch.

How weights are learnt. Expectation-maximisation starts on ratios of estimates
in steps of half a bit, a table bounded by the number of steps, which the driver
gets; `POLISH` rounds over the exact ratios of all held-out tokens follow, whose
sums (a row for each bucket) are all that the driver gets.

Memory: a task holds one batch (a longer text is one of its own) or one shard
(about `SHARD` fingerprints).

Nulls: a null text is empty (its end is a token); a null doc_id is an id of its
own row; ids must be whole numbers. Rows are scored one by one, so copies, ties,
repeated rows and repeated ids all come back; other columns do not, whatever
their names. Without training tokens every known estimate is 0 and the
uniform one counts. Without held-out tokens the weights are equal. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import Tables, durable, joined, small_batches
from veilmark.llm.tokens import mix, word_hashes

ORDER = 2
BATCH_BYTES = 6 << 20
SHARD = 2_000_000
LEAST_BITS = 5
ROUNDS = 60
STEPS = 2  # of a ratio's logarithm, a bit
POLISH = 5

_U = np.uint64
_END, _START = _U(0xE17D_0C0F_FEE0_0001), _U(0x57A2_70F7_E870_0002)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], "<i8").tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    out, at = [], 8 + 16 * n
    for code, size in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """Small numbers byte by byte of their 32 bits, all first bytes first, which compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def from_planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def differences(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit numbers as their differences, byte by byte, all last bytes first: the high bytes are mostly 0."""
    steps = np.diff(keys, prepend=_U(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def from_differences(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel(), dtype=_U)


class Batch:
    """A batch's token stream and its distinct n-grams."""

    def __init__(self, types: np.ndarray, ids: np.ndarray, sizes: np.ndarray, train: np.ndarray, tune: np.ndarray):
        self.types, self.ids, self.sizes = types, ids.astype(np.int64), sizes.astype(np.int64)
        self.train, self.tune = train.astype(bool), tune.astype(bool)
        self.first = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, texts: list[bytes | None], train: np.ndarray, tune: np.ndarray) -> Batch:
        words, first = word_hashes(texts)
        sizes = np.diff(first) + 1
        tokens = np.empty(int(sizes.sum()), _U)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner], tokens[ends] = words, _END
        types, ids, n = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small numbers for frequent types
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return cls(types[order], rank[ids], sizes, train, tune)

    def ngrams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 1 to order: fingerprints of the distinct n-grams, and each token's n-gram among them."""
        each, prints = self.ids, self.types
        yield mix(prints + _U(1)), each
        start = np.zeros(len(each), bool)
        start[self.first] = True
        for n in range(2, order + 1):
            # The n-gram that ends at a token: the (n-1)-gram that ends before it, then the token; a text starts with a start.
            before = np.concatenate(([0], each[:-1]))
            before[start] = len(prints)
            prev = np.concatenate([prints, [_START]])
            uniq, each = np.unique(before * len(self.types) + self.ids, return_inverse=True)
            prints = mix(mix(prev[uniq // len(self.types)]) + self.types[uniq % len(self.types)] * _U(0x9E3779B97F4A7C15))
            yield mix(prints + _U(n)), each


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch_id, tune, entries, blob); the tune fold's documents have batches of their own."""
    from pyspark import TaskContext

    task, k = TaskContext.get().partitionId(), 0
    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}

    def flush(tune: bool) -> pa.RecordBatch:
        nonlocal k
        rows = joined(held[tune])
        held[tune], size[tune] = [], 0
        flags = [rows.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("train", "tune")]
        b = Batch.of(rows.column("text").to_pylist(), *flags)
        ids = rows.column("doc_id")
        blob = pack(b.types, planes(b.ids), b.sizes.astype(np.int32), *flags, pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        k += 1
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([tune]), pa.array([len(b.ids)], pa.int64()), pa.array([blob], pa.binary())], ["batch_id", "tune", "tokens", "blob"])

    for rows_in in rows:
        for tune in (False, True):
            mine = rows_in.filter(rows_in.column("tune") if tune else pa.compute.invert(rows_in.column("tune")))
            lens = pa.compute.fill_null(pa.compute.binary_length(mine.column("text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i, n in enumerate(lens.tolist()):
                if size[tune] and size[tune] + n > BATCH_BYTES:
                    if i > at:
                        held[tune].append(mine.slice(at, i - at))
                    yield flush(tune)
                    at = i
                size[tune] += n + 1
            if len(lens) > at:
                held[tune].append(mine.slice(at))
    for tune in (False, True):
        if held[tune]:
            yield flush(tune)


def _load(blob: bytes) -> tuple[Batch, np.ndarray, np.ndarray]:
    types, ids, sizes, train, tune, doc_ids, null = unpack(blob)
    return Batch(types, from_planes(ids), sizes, train, tune), doc_ids, null


def _split(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the fingerprints, and where each shard's begin in it."""
    order = np.argsort(prints)
    return order, np.searchsorted(prints[order] >> _U(64 - bits), np.arange((1 << bits) + 1).astype(_U))


def _ask(rows: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(n, shard, batch_id, blob): fingerprints with the batch's training and tune counts."""
    for batch in rows:
        for batch_id, blob in zip(batch.column("batch_id").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            b, _, _ = _load(blob)
            train, tune = np.repeat(b.train, b.sizes), np.repeat(b.train & b.tune, b.sizes)
            for n, (prints, each) in enumerate(b.ngrams(order), 1):
                counts = [np.bincount(each[flag], minlength=len(prints)).astype(np.uint32) for flag in (train, tune)]
                at, cut = _split(prints, bits)
                for shard in np.flatnonzero(np.diff(cut)).tolist():
                    part = slice(cut[shard], cut[shard + 1])
                    value = pack(differences(prints[at[part]]), *(planes(c[at[part]]) for c in counts))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((n, pa.int32()), (shard, pa.int32()), (batch_id, pa.int64()), (value, pa.binary()))], ["n", "shard", "batch_id", "blob"])


_ANSWERS = pa.schema([("batch_id", pa.int64()), ("n", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary()), ("types", pa.int64()), ("total", pa.int64()), ("types_less", pa.int64()), ("total_less", pa.int64())])


def _answer(table: pa.Table) -> pa.Table:
    """Adds up a shard; a row for each batch, and one (batch_id null) with the shard's numbers of types and tokens."""
    parts = [unpack(v) for v in table.column("blob").to_pylist()]
    sizes = np.array([len(p[1]) // 4 for p in parts])
    n, shard = table.column("n")[0].as_py(), table.column("shard")[0].as_py()
    keys = np.concatenate([from_differences(p[0]) for p in parts])
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    every, tuned = (np.add.reduceat(np.concatenate([from_planes(p[k]) for p in parts])[order], begin) for k in (1, 2))
    less = every - tuned
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(keys)]))))
    cut = np.concatenate(([0], np.cumsum(sizes)))
    rows = [(i, n, shard, pack(planes(every[group[a:b]]), planes(tuned[group[a:b]])), 0, 0, 0, 0) for i, a, b in zip(table.column("batch_id").to_pylist(), cut, cut[1:])]
    rows.append((None, n, shard, b"", int((every > 0).sum()), int(every.sum()), int((less > 0).sum()), int(less.sum())))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWERS, strict=True)], schema=_ANSWERS)


def _estimates(b: Batch, answers: pa.Table, order: int, bits: int, less: bool, total: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Each token's own count, its maximum-likelihood estimates for n = 1 to order, and its bucket."""
    got = {(n, s): v for n, s, v in zip(*(answers.column(c).to_pylist() for c in ("n", "shard", "blob")), strict=True)}
    start = np.zeros(len(b.ids), bool)
    start[b.first] = True
    out, bucket, context, own = [], None, None, None
    for n, (prints, each) in enumerate(b.ngrams(order), 1):
        at, cut = _split(prints, bits)
        counts = np.zeros(len(prints), np.int64)
        filled = [[from_planes(x) for x in unpack(got[n, s])] for s in np.flatnonzero(np.diff(cut)).tolist()]
        counts[at] = np.concatenate([every - tuned if less else every for every, tuned in filled])
        mine = counts[each].astype(float)
        if n == 1:
            out.append(mine / max(total, 1))
            own = mine
            starts = float(counts[np.flatnonzero(b.types == _END)[0]])  # as many starts as ends
        else:
            out.append(np.divide(mine, context, out=np.zeros(len(mine)), where=context > 0))
        # A longer context does not reach beyond its text's start: there the shorter one's estimate is all there is.
        context = np.where(start, starts if n == 1 else 0.0, np.concatenate(([0.0], mine[:-1])))
        if n == 1:
            bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)
    return own, out, bucket


def _ratios(tokens: pa.Table, answers: pa.Table, order: int, bits: int, total: int, types: int) -> pa.Table:
    """(bucket, each order's ratio to the uniform estimate, n) of a tune batch."""
    b, _, _ = _load(tokens.column("blob")[0].as_py())
    _, p, bucket = _estimates(b, answers, order, bits, True, total)
    keep = np.repeat(b.train & b.tune, b.sizes)
    rows, n = np.unique(np.stack([bucket, *(x * (types + 1) for x in p)], 1)[keep], axis=0, return_counts=True)
    return pa.table({"bucket": rows[:, 0].astype(np.int64), "ratios": pa.array(rows[:, 1:].tolist(), pa.list_(pa.float64())), "n": n.astype(np.int64)}, schema=pa.schema([("bucket", pa.int64()), ("ratios", pa.list_(pa.float64())), ("n", pa.int64())]))


def _posteriors(batches: Iterator[pa.RecordBatch], weights: dict[int, np.ndarray], order: int) -> Iterator[pa.RecordBatch]:
    """(bucket, own, every): each bucket's sums of the estimates' shares, under its own weights and under those of all."""
    for batch in batches:
        bucket, n = batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
        estimate = np.concatenate([np.ones((len(n), 1)), batch.column("ratios").flatten().to_numpy().reshape(-1, order)], 1)
        names, at = np.unique(bucket, return_inverse=True)
        out = []
        for w in (np.stack([weights.get(b, weights[-1]) for b in names.tolist()] or [weights[-1]])[at], weights[-1]):
            share = estimate * w
            share *= (n / share.sum(1))[:, None]
            sums = np.zeros((len(names), order + 1))
            np.add.at(sums, at, share)
            out.append(pa.array(sums.tolist(), pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays([pa.array(names), *out], ["bucket", "own", "every"])


def fit_weights(ratios: DataFrame, order: int, polish: int = POLISH) -> dict[int, np.ndarray]:
    """Mixture weights by bucket, -1 for all of them. ratios: bucket, ratios, n."""
    step = F.transform("ratios", lambda r: F.when(r > 0, F.round(F.log2(r) * STEPS)).otherwise(-10_000).cast("bigint"))
    held = ratios.groupBy("bucket", step.alias("steps")).agg(F.sum("n").alias("n")).toArrow()  # bounded by the steps
    weights = learn_weights(held.column("bucket").to_numpy(), np.array(held.column("steps").to_pylist(), np.int64).reshape(-1, order), held.column("n").to_numpy(), order)
    for _ in range(polish if held.num_rows else 0):
        rows = ratios.mapInArrow(lambda batches, w=dict(weights): _posteriors(batches, w, order), "bucket bigint, own array<double>, every array<double>")
        sums = rows.groupBy("bucket").agg(*(F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("own", "every") for i in range(order + 1))).collect()  # a row for each power of two
        every = sum((np.array([r[f"every{i}"] for i in range(order + 1)]) for r in sums), np.full(order + 1, 1e-6))
        weights[-1] = np.maximum(every / every.sum(), 1e-9)
        for r in sums:
            w = np.array([r[f"own{i}"] for i in range(order + 1)]) + 20 * weights[-1]
            weights[r["bucket"]] = np.maximum(w / w.sum(), 1e-9)
    return {b: w / w.sum() for b, w in weights.items()}


def learn_weights(bucket: np.ndarray, steps: np.ndarray, n: np.ndarray, order: int, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Mixture weights of each bucket by expectation-maximisation; few tokens lean on the weights of all (-1)."""
    ratio = np.concatenate([np.ones((len(n), 1)), np.where(steps > -10_000, 2.0 ** (np.clip(steps, -2000, 2000) / STEPS), 0.0)], 1)

    def run(rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            share = ratio[rows] * w
            share *= (n[rows] / share.sum(1))[:, None]
            w = share.sum(0) + prior
            w /= w.sum()
        return np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()

    if not len(n):
        return {-1: np.full(order + 1, 1 / (order + 1))}
    out = {-1: run(np.arange(len(n)), np.full(order + 1, 1e-6))}
    for b in np.unique(bucket).tolist():
        out[b] = run(np.flatnonzero(bucket == b), 20 * out[-1])
    return out


def _scored(tokens: pa.Table, answers: pa.Table, order: int, bits: int, total: int, types: int, weights: dict[int, np.ndarray], schema: pa.Schema) -> pa.Table:
    b, doc_ids, null = _load(tokens.column("blob")[0].as_py())
    own, p, bucket = _estimates(b, answers, order, bits, False, total)
    top = max(bucket.max(initial=0), *weights) + 1
    table = np.stack([weights.get(k, weights[-1]) for k in range(top)])
    w = table[bucket]
    mixed = w[:, 0] / (types + 1) + sum(w[:, i + 1] * x for i, x in enumerate(p))
    add = lambda x: np.add.reduceat(x, b.first) if len(b.first) else np.zeros(0)
    base = np.log10((own + 1) / (total + types + 1))
    return pa.table([pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(b.sizes), pa.array(add((own > 0).astype(np.int64))), pa.array(np.full(len(doc_ids), total)), pa.array(add(base)), pa.array(add(np.log10(mixed)))], schema=schema)


def score(docs: DataFrame, train: Column, tune: Column, order: int = ORDER, weights: dict[int, np.ndarray] | None = None) -> DataFrame:
    """docs: doc_id (bigint), text; train and tune: which rows are learnt from, and which of these set the weights, unless they are given.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 of the text's probability).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(train & tune, F.lit(False)).alias("tune"))
    tokens = durable(rows.mapInArrow(_batches, "batch_id bigint, tune boolean, tokens bigint, blob binary"))
    entries = order * (tokens.agg(F.sum("tokens")).first()[0] or 0)
    bits = max(LEAST_BITS, math.ceil(math.log2(max(entries, 1) / SHARD)))
    asked = tokens.select("batch_id", "blob").mapInArrow(lambda r: _ask(r, order, bits), "n int, shard int, batch_id bigint, blob binary")
    answers = durable(asked.groupBy("n", "shard").applyInArrow(_answer, "batch_id bigint, n int, shard int, blob binary, types bigint, total bigint, types_less bigint, total_less bigint"))
    s = answers.where("batch_id is null and n = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "total", "types_less", "total_less"))).first()
    replies = answers.where("batch_id is not null").select("batch_id", "n", "shard", "blob")
    if weights is None:
        tuning = tokens.where("tune").select("batch_id", "blob")
        theirs = replies.join(tuning.select("batch_id"), "batch_id", "left_semi")
        ratios = tuning.groupBy("batch_id").cogroup(theirs.groupBy("batch_id")).applyInArrow(lambda a, b: _ratios(a, b, order, bits, s["total_less"], s["types_less"]), "bucket bigint, ratios array<double>, n bigint")
        with Tables(spark) as tables:
            weights = fit_weights(tables.put(ratios.groupBy("bucket", "ratios").agg(F.sum("n").alias("n"))), order)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return tokens.select("batch_id", "blob").groupBy("batch_id").cogroup(replies.groupBy("batch_id")).applyInArrow(lambda a, b: _scored(a, b, order, bits, s["total"], s["types"], weights, schema), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
