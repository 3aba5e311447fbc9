"""Token counts: batch encoding inside Arrow functions that returns lengths only.

Rows are regrouped into batches of about `BATCH_BYTES` of text, and these go to
the library in slices of about `SLICE_BYTES`. Texts of over `PIECE` characters
are split at safe boundaries first: before a single space between two visible
characters, where neither tokenizers that part words at blanks nor byte-level
ones that carry one space into the next word can put a token across. A stretch
without such a boundary stays whole, and a .model file, whose pieces may hold
blanks, is counted by whole text.

A worker holds one batch (a longer text is one of its own). Null texts count as
empty: 0 bytes, 0 tokens. Copies, ties, repeated rows and ids and further columns
pass through row by row; `n_bytes`, `n_tokens` and `over_limit` are overwritten.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import by_bytes, schema_of, small_batches, spare

BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 18
PIECE = 1 << 15
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


class Counter:
    """Lengths of texts under one tokenizer."""

    def __init__(self, content: bytes, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if kind == "json":
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(content.decode())
            tok.no_truncation()
            tok.no_padding()
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.lengths = lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)]
        self.pieces = kind == "json"

    def sliced(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t.encode()) + 16
            if size >= SLICE_BYTES:
                out += self.lengths(held)
                held, size = [], 0
        return out + (self.lengths(held) if held else [])

    def count(self, texts: list[bytes]) -> list[int]:
        pieces: list[str] = []
        own: list[int] = []
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            cut = self.cuts(text) if self.pieces else [0, len(text)]
            pieces += [text[a:b] for a, b in zip(cut, cut[1:])]
            own += [i] * (len(cut) - 1)
        return np.bincount(own, self.sliced(pieces), len(texts)).astype(np.int64).tolist() if own else [0] * len(texts)

    def cuts(self, text: str) -> list[int]:
        out = [0]
        while len(text) - out[-1] > PIECE and (m := _BETWEEN.search(text, out[-1] + PIECE)):
            out.append(m.start())
        return [*out, len(text)]


_loaded: dict[str, Counter] = {}


def _counter(content: bytes, kind: str) -> Counter:
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counter(content, kind)
    return _loaded[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit of `text`; path: the tokenizer's file, .json or .model."""
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary, of fixed size
    kind = "model" if path.endswith(".model") else "json"

    plain = docs.drop("n_bytes", "n_tokens", "over_limit")
    raw = spare(plain, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(content.value, kind)
        for batch in by_bytes(batches, raw, BATCH_BYTES):
            i = batch.schema.get_field_index(raw)
            n = counter.count([t or b"" for t in batch.column(i).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != i), pa.array(n, pa.int64())], [*(c for c in batch.schema.names if c != raw), "n_tokens"])

    counted = plain.withColumn(raw, F.col("text").cast("binary"))
    counted = counted.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return counted.mapInArrow(run, schema_of(counted.drop(raw), ("n_tokens", "bigint"))).withColumn("over_limit", F.col("n_tokens") > limit)
