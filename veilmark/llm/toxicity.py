"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, are smoothed through one
shared backoff. Interpolated Kneser-Ney smoothing takes the class as the first
word of each context, so its levels are

* class and word before: the number of distinct words that stand before the
  pair in that class (a text copied many times adds no more than one text);
* class: the number of distinct words before a word in that class;
* shared: the number of classes, one or two, in which a word occurs at all;
* one more type, of any word that no class has.

Each level gives up one absolute discount from each of its counts to the next
one, n1 / (n1 + 2 n2) with n1 and n2 the counts that are one and two. So a rare
expression leans on the shared counts, where the classes are alike, and a
frequent one of one class only stands out the more the oftener it is said.

A document's evidence is the difference of length-normalised log-likelihoods
over its whole text, and that of its most toxic expression (word, by the class
level). A logistic curve fitted on labelled rows that gave no counts turns the
two into a score.

Fitting takes at most `per_class` labelled documents a class for the counts and
`calibration` for the curve (documented bounds; the smallest hashes of doc_id
are taken, ties by doc_id). The model holds the sample's distinct pairs, which
its bound bounds, and is sent to the tasks once.

Nulls: a null text is an empty one; a null label is no label. Empty texts have
no evidence and get the curve's score for none. Very long texts are scored whole, one at
a time if need be. Copies, repeated rows and repeated ids are scored row by row;
of repeated labels of an id the larger counts. With no rows of one of the classes
every score is the toxic share of the labelled rows (0.0 if there are none).
Other columns pass through, but `score` is overwritten.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import by_bytes, release, schema_of, small_batches, spare, stored
from veilmark.llm.tokens import NOT_ALNUM, grams, mix, word_hashes

PER_CLASS = 1500
CALIBRATION = 4000
BATCH_BYTES = 1 << 20

_U = np.uint64


@dataclass
class Lookup:
    """Sorted fingerprints and a value for each."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Lookup:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def get(self, wanted: np.ndarray, default: float | np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(wanted):
            return np.full(len(wanted), default) if np.isscalar(default) else default
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], default)


@dataclass
class ToxicityModel:
    """Log-likelihood ratios a word adds, and the curve's weights (bias, whole text, strongest expression)."""

    pairs: Lookup
    contexts: Lookup
    words: Lookup
    unseen: float
    curve: tuple[float, float, float] = (0.0, 1.0, 1.0)
    constant: float | None = None

    def evidence(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood ratio of each text, and the largest one of its words."""
        words, first = word_hashes(texts, NOT_ALNUM)
        n = np.diff(first)
        alone = self.words.get(words, self.unseen)
        ratio = alone
        if len(words) > 1:
            inner = np.ones(len(words), bool)
            inner[first[:-1][n > 0]] = False
            before = words[np.maximum(np.arange(len(words)) - 1, 0)]
            ratio = np.where(inner, self.pairs.get(_pair(before, words), alone + self.contexts.get(before, 0.0)), alone)
        sums = np.concatenate(([0.0], np.cumsum(ratio)))
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        most = np.zeros(len(texts))
        if (n > 0).any():
            most[n > 0] = np.maximum.reduceat(alone, first[:-1][n > 0])
        return mean, most

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        mean, most = self.evidence(texts)
        bias, a, b = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(bias + a * mean + b * most, -50, 50)))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) + right)


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, pair, first, second, toxic): the distinct runs of three words of each class in a batch; a text's own start counts as a word before."""
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        label = batch.column("toxic").to_numpy()
        words, first = word_hashes(batch.column("text").to_pylist(), NOT_ALNUM)
        both, begin = grams(words, first, 2)
        at = np.arange(len(both)) + np.repeat(first[:-1] - begin[:-1], np.diff(begin))
        own = np.repeat(label, np.diff(begin))
        start = np.zeros(len(both), bool)
        start[begin[:-1][np.diff(begin) > 0]] = True
        before = np.where(start, _U(0), words[np.maximum(at - 1, 0)])
        pair = _pair(words[at], words[at + 1])
        key = mix(mix(before) + pair)
        for c in (0, 1):
            _, once = np.unique(key[own == c], return_index=True)
            once = np.flatnonzero(own == c)[once]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[once].view(np.int64)) for x in (key, pair, words[at], words[at + 1])), pa.array(np.full(len(once), c, np.int32))], ["run", "pair", "first", "second", "toxic"])


def sample(labelled: DataFrame, per_class: int, salt: str) -> DataFrame:
    """At most per_class rows of each class, by the smallest hashes of doc_id."""
    rank = F.xxhash64(F.lit(salt), F.col("doc_id"))
    return labelled.where("toxic = 1").orderBy(rank, "doc_id").limit(per_class).unionByName(labelled.where("toxic = 0").orderBy(rank, "doc_id").limit(per_class))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibration: int = CALIBRATION) -> ToxicityModel:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1). Every fourth labelled id, by hash, calibrates."""
    small_batches(docs.sparkSession)
    labelled = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    side = F.pmod(F.xxhash64(F.lit("side"), F.col("doc_id")), F.lit(4)) == 0
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    ids = sample(labelled.where(~side), per_class, "counts").withColumn("use", F.lit(0)).unionByName(labelled.where(side).orderBy(F.xxhash64(F.lit("curve"), F.col("doc_id")), "doc_id").limit(calibration).withColumn("use", F.lit(1)))
    # At most 2 * per_class + calibration ids of 8 bytes: a proven bound.
    chosen = texts.join(F.broadcast(ids), "doc_id").select("text", "toxic", "use")
    shares = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return ToxicityModel(Lookup(), Lookup(), Lookup(), 0.0, constant=float(1 in shares))
    with stored(chosen) as sampled:
        runs = sampled.where("use = 0").select("text", "toxic").mapInArrow(_expressions, "run bigint, pair bigint, first bigint, second bigint, toxic int")
        pairs = (
            runs.groupBy("run", "pair", "first", "second").agg(*(F.max((F.col("toxic") == c).cast("int")).alias(f"n{c}") for c in (0, 1)))
            .groupBy("pair", "first", "second").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"))
        )
        t = pairs.toArrow()  # the sample's distinct pairs
        model = estimate(*(t.column(c).to_numpy().view(_U) for c in ("pair", "first", "second")), np.stack([t.column("n0").to_numpy(), t.column("n1").to_numpy()]))
        del t
        release()
        told = docs.sparkSession.sparkContext.broadcast(model)
        held = sampled.where("use = 1").select("text", "toxic").mapInArrow(lambda batches: _evidence(batches, told.value), "mean double, most double, toxic int").toArrow()
    x = np.stack([np.ones(held.num_rows), held.column("mean").to_numpy(), held.column("most").to_numpy()], 1)
    model.curve = _logistic(x, held.column("toxic").to_numpy().astype(float))
    return model


def discount(counts: np.ndarray) -> float:
    """One absolute discount in (0, 1) from the counts that are one and two; a half without either."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(one / (one + 2 * two), 0.01), 0.99) if one or two else 0.5


def estimate(pair: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> ToxicityModel:
    """The model of distinct pairs (fingerprints of the pair and its words) with n, a row for each class, of distinct words before each."""
    words, word = np.unique(second, return_inverse=True)
    firsts, context = np.unique(first, return_inverse=True)
    types = len(np.union1d(words, firsts))
    m = np.stack([np.bincount(word, row > 0, len(words)) for row in n])
    classes = (m > 0).sum(0)
    base = discount(classes)
    every = max(classes.sum(), 1)
    shared = np.maximum(classes - base, 0) / every + base * len(words) / every / (types + 1)
    alone, left_over, joint, spared = [], [], [], []
    for c in (0, 1):
        d = discount(m[c])
        size = max(m[c].sum(), 1)
        left_over.append(d * (m[c] > 0).sum() / size if m[c].any() else 1.0)
        alone.append(np.maximum(m[c] - d, 0) / size + left_over[c] * shared)
        d = discount(n[c])
        size = np.bincount(context, n[c], len(firsts))
        spared.append(np.where(size > 0, d * np.bincount(context, n[c] > 0, len(firsts)) / np.maximum(size, 1), 1.0))
        joint.append(np.maximum(n[c] - d, 0) / np.maximum(size[context], 1) + spared[c][context] * alone[c][word])
    ratio = lambda both: np.log(both[1] / both[0])
    return ToxicityModel(Lookup.of(pair, ratio(joint).astype(np.float32)), Lookup(firsts, ratio(spared).astype(np.float32)), Lookup(words, ratio(alone)), math.log(left_over[1] / left_over[0]))


def _evidence(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        mean, most = model.evidence(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(mean), pa.array(most), batch.column("toxic")], ["mean", "most", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Newton's method with a small ridge; without rows of both classes no evidence counts."""
    if len(set(y.tolist())) < 2:
        return (math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0, 0.0)
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + ridge / 2 * v @ v
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with `score` (0 to 1) of the whole text; `text` stays as it is."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    plain = docs.drop("score")
    raw = spare(plain, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, raw, BATCH_BYTES):
            i = batch.schema.get_field_index(raw)
            out = pa.array(told.value.scores(batch.column(i).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != i), out], [*(c for c in batch.schema.names if c != raw), "score"])

    return plain.withColumn(raw, F.col("text").cast("binary")).mapInArrow(run, schema_of(plain, ("score", "double")))
