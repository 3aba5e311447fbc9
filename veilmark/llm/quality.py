"""Quality by co-training of a text view and a metadata view.

The text view sees what a document says: shares of letters, digits, symbols and
blanks, lengths of words and lines, repetition, and hashed word frequencies.
The metadata view sees language, source, the stated length and the size in
bytes, and their crosses (source and language, source and length band, language
and length band), never the text. Each view has a logistic classifier, whose
log-odds are calibrated on labelled rows that are kept apart.

In each of `rounds` rounds both views score all documents without a label. A
view is sure of a document if its calibrated probability of a class has come at
least half of the way from that class's share to one; it gives `given` of those
it is sure of, the two classes in the labels' proportion and the smallest hashes
first, as pseudo-labelled rows to the other view. A view whose calibrated
log-loss on the rows kept apart is no better than the class shares' gives nothing.
At the end both are calibrated again, and a logistic curve over both combines them, with
no weight below zero: a view that would get one is left out.

Fitting takes at most `labelled` labelled documents, of which a quarter
calibrates (a documented bound; the smallest hashes of doc_id are taken), and in
each round at most twice `given` pseudo-labelled ones, chosen among all. The fitted
weights, a few hundred numbers, are sent to the tasks, which score every whole
document.

Nulls: a null text is empty, a null language or source a value of its own, a
null length 0; a null label is no label; rows with a null doc_id are scored but
not learnt from. Very long texts are one row of features each. Copies, repeated
rows and repeated ids are scored row by row; of repeated labels the larger
counts; ties go by hash of the id, then by id. With no labels of one of the classes every score is the share of
good ones (0.5 without any). Other columns pass through; `text_score`,
`meta_score` and `score` are overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import Tables, by_bytes, schema_of, small_batches, spare
from veilmark.llm.tokens import word_hashes

LABELLED, ROUNDS, GIVEN = 6000, 3, 600
WORD_BINS, META_BINS = 128, 256
WIDTH = 14 + WORD_BINS
BATCH_BYTES = 1 << 20

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_BLANK = np.array([b in (32, *range(9, 14)) for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_KINDS = np.stack([_LETTER, _DIGIT, _BLANK, _UPPER, ~(_LETTER | _DIGIT | _BLANK), np.arange(256) == 124, np.arange(256) == 10]).astype(np.float64)


def text_view(texts: list[bytes | None]) -> np.ndarray:
    """A row of features for each text."""
    words, first = word_hashes(texts)
    out = np.zeros((len(texts), WIDTH))
    bins = (words >> np.uint64(40)).astype(np.int64) % WORD_BINS
    for i, raw in enumerate(texts):
        raw = raw or b""
        own = words[first[i] : first[i + 1]]
        n, size = max(len(own), 1), max(len(raw), 1)
        share = _KINDS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
        lines = raw.split(b"\n")
        distinct = len(np.unique(own))
        again = int((own[1:] == own[:-1]).sum())
        out[i, :14] = [*share, np.log1p(len(raw)), np.log1p(len(own)), distinct / n, again / n, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), size / n / 10]
        count = np.bincount(bins[first[i] : first[i + 1]], minlength=WORD_BINS) / n
        out[i, 14:] = np.sqrt(count)
    return out


def meta_view(lang: list, source: list, n_chars: list, n_bytes: list) -> np.ndarray:
    """A row of features for each document's metadata."""
    size, raw = (np.log1p(np.array([max(v or 0, 0) for v in values], float)) for values in (n_chars, n_bytes))
    out = np.zeros((len(lang), META_BINS + 3))
    said = lambda v: b"\x00" if v is None else b"=" + v.encode().replace(b" ", b"_")
    band = (size * 2).astype(int).tolist()
    words = [b"l%b s%b n%d ls%b%b sn%b%d ln%b%d" % (x, y, n, x, y, y, n, x, n) for x, y, n in zip(map(said, lang), map(said, source), band, strict=True)]
    prints, first = word_hashes(words)
    own = np.repeat(np.arange(len(lang)), np.diff(first))
    out[own, (prints >> np.uint64(33)).astype(np.int64) % META_BINS] = 1.0
    out[:, -3], out[:, -2], out[:, -1] = size / 5, (size / 5) ** 2, raw - size
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last one the bias, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + (hold * v * v).sum() / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - y) + hold * w)
        size = 1.0
        while size > 1e-3 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The curve (slope, not below zero, and bias) from log-odds to calibrated ones."""
    curve = logistic(z[:, None], y, 1e-2)
    return curve if curve[0] > 0 else np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])


def combined(each: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over columns of log-odds, none below zero."""
    use = np.ones(each.shape[1], bool)
    while True:
        w = logistic(each[:, use], y, 1e-2)
        if (w[:-1] >= 0).all():
            out = np.zeros(each.shape[1] + 1)
            out[:-1][use], out[-1] = w[:-1], w[-1]
            return out
        use[np.flatnonzero(use)[w[:-1] < 0]] = False


@dataclass
class CoTrained:
    views: tuple[np.ndarray, np.ndarray] | None
    curves: tuple[np.ndarray, np.ndarray] | None = None  # a view's log-odds to calibrated ones
    both: np.ndarray | None = None
    constant: float = 0.5
    share: float = 0.5  # of good labels
    gives: tuple[bool, bool] = (False, False)

    def odds(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Calibrated log-odds, a column for each view."""
        return np.stack([odds(odds(x, w)[:, None], c) for x, w, c in zip(xs, self.views, self.curves, strict=True)], 1)

    def scores(self, xs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Calibrated probability of each view, then of both."""
        if self.views is None:
            return [np.full(len(xs[0]), self.constant)] * 3
        z = self.odds(xs)
        return [1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (*z.T, odds(z, self.both))]

    def sure(self, xs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """For each view: 1 or 0 where it is sure of a class, else -1."""
        p = 1 / (1 + np.exp(-np.clip(self.odds(xs), -40, 40)))
        good, bad = p >= (1 + self.share) / 2, 1 - p >= (2 - self.share) / 2
        return [np.where(good[:, v], 1, np.where(bad[:, v], 0, -1)) if self.gives[v] else np.full(len(p), -1) for v in (0, 1)]


def fitted(train: list[tuple[np.ndarray, np.ndarray]], apart: tuple[np.ndarray, np.ndarray], y: np.ndarray, share: float) -> CoTrained:
    """Both views' classifiers, calibrated and combined on the rows kept apart (views, labels)."""
    views = tuple(logistic(x, t) for x, t in train)
    curves = tuple(calibrated(odds(x, w), y) for x, w in zip(apart, views, strict=True))
    model = CoTrained(views, curves, share=share)
    z = model.odds(apart)
    loss = lambda v: np.logaddexp(0, v).mean() - (y * v).mean()
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    # Better than the shares by more than the two numbers of a curve may gain by chance.
    model.gives = tuple(bool(loss(z[:, v]) < loss(np.full(len(y), prior)) - 3 / len(y)) for v in (0, 1))
    model.both = combined(z, y)
    return model


def _views(batch: pa.RecordBatch, names: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: batch.column(batch.schema.get_field_index(names[c])).to_pylist()
    texts = column("text")
    return text_view(texts), meta_view(column("lang"), column("source"), column("n_chars"), [len(t or b"") for t in texts])


def _inputs(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with the views' inputs under names of their own."""
    names = {c: spare(docs, f"{c}_in") for c in ("text", "lang", "source", "n_chars")}
    kinds = {"text": "binary", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.withColumns({n: F.col(c).cast(kinds[c]) for c, n in names.items()}), names


def _rank() -> tuple:
    return F.xxhash64(F.lit("quality"), F.col("doc_id")), F.col("doc_id")


def _known(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lang, source, n_chars, n_bytes, x) of each row: the text view as 32-bit numbers, which is all of the text that rounds need."""
    rows, names = _inputs(docs)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, names["text"], BATCH_BYTES):
            x = text_view(batch.column(batch.schema.get_field_index(names["text"])).to_pylist()).astype(np.float32)
            keep = ["doc_id", "key", "lang", "source", "n_chars", "n_bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    inner = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("bigint").alias("n_chars"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), names["text"])
    return inner.mapInArrow(run, f"doc_id {kinds['doc_id']}, key bigint, lang string, source string, n_chars bigint, n_bytes bigint, x binary")


def _views_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of `_known`."""
    text = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)
    return text, meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars", "n_bytes"))).astype(np.float32).astype(float)


def _features(known: DataFrame, chosen: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Both views, `y` and `mark` of the chosen documents (doc_id, y, mark), whose number the caller bounds."""
    got = known.join(F.broadcast(chosen), "doc_id").toArrow().sort_by([("key", "ascending"), ("mark", "ascending")])
    return _views_of(got), got.column("y").to_numpy().astype(float), got.column("mark").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained:
    """docs: doc_id, text, lang, source, n_chars. labels: doc_id, quality (0 or 1)."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    taken = known.orderBy(*_rank()).limit(labelled).withColumn("mark", (F.pmod(F.xxhash64(F.lit("apart"), F.col("doc_id")), F.lit(4)) == 0).cast("int"))
    with Tables(spark) as tables:
        # Texts are read once; the rounds go over this table.
        rows = tables.put(_known(docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")))
        xs, y, mark = _features(rows, taken)  # at most `labelled` ids
        held = mark == 1
        if len(set(y[~held].tolist())) < 2:
            return CoTrained(None, constant=float(y.mean()) if len(y) else 0.5)
        learns = ~held
        if len(set(y[held].tolist())) < 2:
            held = learns = np.ones(len(y), bool)  # too few to keep any apart
        share = float(y[learns].mean())
        train = [(x[learns], y[learns]) for x in xs]
        apart = tuple(x[held] for x in xs)
        model = fitted(train, apart, y[held], share)
        used = None
        for _ in range(rounds):
            if not any(model.gives):
                break
            sure = _sure(rows, model).join(known.select("doc_id"), "doc_id", "left_anti")
            if used is not None:
                sure = sure.join(F.broadcast(used), "doc_id", "left_anti")  # at most 2 * given ids a round
            parts = [sure.where((F.col("view") == v) & (F.col("y") == c)).select("doc_id", "y", F.col("view").alias("mark")).distinct().orderBy(*_rank()).limit(n) for v in (0, 1) if model.gives[v] for c, n in ((1, round(given * share)), (0, round(given * (1 - share))))]
            new = tables.put(reduce(DataFrame.unionByName, parts).coalesce(1))
            xs, t, by = _features(rows, new)
            if not len(t):
                break
            for v in (0, 1):
                mine = by == 1 - v
                train[v] = np.concatenate([train[v][0], xs[v][mine]]), np.concatenate([train[v][1], t[mine]])
            taken = new.select("doc_id").distinct()
            used = taken if used is None else used.unionByName(taken)
            model = fitted(train, apart, y[held], share)
    return model


def _sure(rows: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, view, y): the documents of which a view is sure."""
    told = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view, y in enumerate(told.value.sure(_views_of(batch))):
                at = np.flatnonzero(y >= 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(np.full(len(at), view, np.int32)), pa.array(y[at].astype(np.int32))], ["doc_id", "view", "y"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, view int, y int")


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs with text_score, meta_score and score, the probability of good quality."""
    small_batches(docs.sparkSession)
    added = ["text_score", "meta_score", "score"]
    plain = docs.drop(*added)
    rows, names = _inputs(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, names["text"], BATCH_BYTES):
            keep = [c for c in batch.schema.names if c not in names.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(v) for v in model.scores(_views(batch, names)))], [*keep, *added])

    return rows.mapInArrow(run, schema_of(plain, *((n, "double") for n in added)))
