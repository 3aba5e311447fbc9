"""BPE encoding and decoding with an index of pair occurrences.

The words of a batch that were not met before are laid end to end as symbols.
An index maps each adjacent pair that the vocabulary can merge, by its rank, to
all positions where it stands. Active ranks are taken in ascending order from a
heap: the positions of a rank are merged together, and the pairs this makes
with the neighbours are looked up and appended to the lists of their ranks.
(A merge's parts always come from earlier merges, which loading verifies, so no
list of a rank that is done gains positions.)

The normaliser, the added special strings and the splitting into pieces follow
the tokenizer's file, by the library's own normaliser and pre-tokenizer; words
of plain ASCII, or of letters that are normal already, are split here if loading
finds that this gives the same for every pair of ASCII characters and for
`PROBES`. Decoding looks each id's token up and joins tokens by spaces, as the
library does where the file has no decoder.

Memory is bounded by one batch of about `BATCH_BYTES` of text (a longer text is
a batch of its own) and a memo of `MEMO` words. Null texts are empty ones: no
ids. Rows are handled one by one, so copies, ties, repeated rows and ids and
further columns pass through; the columns that `encode` adds are overwritten. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import by_bytes, schema_of, small_batches, spare

BATCH_BYTES = 3 << 20
MEMO = 200_000
#: Words that the own splitting must treat as the file does, beside all pairs of ASCII characters.
PROBES = ("don't", "DON'T", "we'll've", "it's's", "I'M'RE'D", "a1b22c333", "x...y!!", "foo_bar-Baz9", "''s", "abcDEF'sghi", "naïve", "été", "straße", "привет")
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")


def byte_units() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself where printable, else the next of U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    units = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in units):
        units[b] = chr(0x100 + k)
    return units


class Codec:
    """One vocabulary with its merges."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or spec.get("decoder"):
            raise ValueError("a BPE file with </w> as end of word and no decoder is needed")
        self.library = Tokenizer.from_str(content.decode())
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens are matched as they stand in the text")
        self.added = {k.encode(): v for k, v in added.items()}
        self.split_added = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if added else None
        units = byte_units()
        self.byte_of = {u: b for b, u in units.items()}
        self.inner = np.array([vocab[units[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[units[b] + "</w>"] for b in range(256)], np.int64)
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in parts], np.int64)
        self.right = np.array([vocab[b] for _, b in parts], np.int64)
        self.made = np.array([vocab[a + b] for a, b in parts], np.int64)
        first_made = np.full(max(vocab.values()) + 1, -1)
        first_made[self.made[::-1]] = np.arange(len(parts))[::-1]
        if (np.maximum(first_made[self.left], first_made[self.right]) >= np.arange(len(parts))).any():
            raise ValueError("a merge comes before one that makes its parts")
        keys = self.left << 32 | self.right
        self.rank_order = np.argsort(keys)
        self.keys = keys[self.rank_order]
        self.tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for t, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = t.encode()
        self.memo: dict[bytes, bytes] = {}
        shown = [chr(c) for c in range(0x21, 0x7F)]
        self.own_split = all(self.split_own(w.encode()) == self.split(w) for w in [*(a + b for a in shown for b in shown), *PROBES])

    def split(self, text: str) -> list[bytes]:
        """The pieces of a word, by the library."""
        return [bytes(self.byte_of[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def split_own(self, word: bytes) -> list[bytes]:
        """The same for most words, faster."""
        if word.isascii():
            return [word.lower()] if word.isalpha() else _ASCII.findall(word.lower())
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return [word]
        return self.split(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where none merges it."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_order[at], -1)

    def pieces(self, word: bytes) -> list[bytes | int]:
        """What is merged separately, as UTF-8; an id for an added special string."""
        out: list[bytes | int] = []
        for part in self.split_added.split(word) if self.split_added and self.split_added.search(word) else [word]:
            if part in self.added:
                out.append(self.added[part])
            else:
                out += self.split_own(part) if self.own_split else self.split(part.decode("utf-8", "replace"))
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and where each piece's ids begin (one more entry at the end)."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lens)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lens] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Adds the pairs that start at these positions to the index."""
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, where in zip(rank[[0, *cut]].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(where)

        note(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # of a run of one symbol the pairs are taken from its left
                keep, taken = [], -1
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = after[p]
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = self.made[r], -1
            then = after[gone]
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            prev = before[at]
            note(np.concatenate([prev[prev >= 0], at[then >= 0]]))
        alive = sym >= 0
        begin = np.concatenate(([0], np.cumsum(alive)))
        return sym[alive], begin[np.concatenate(([0], ends))]

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of these words, as little-endian 32-bit integers, into the memo."""
        split = [self.pieces(w) for w in words]
        texts = [p for ps in split for p in ps if type(p) is bytes and p]
        ids, begin = self.merge(texts) if texts else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        raw, at, k = ids.astype("<u4").tobytes(), (begin * 4).tolist(), 0
        for w, ps in zip(words, split, strict=True):
            if len(ps) == 1 and type(ps[0]) is bytes and ps[0]:
                self.memo[w] = raw[at[k] : at[k + 1]]
                k += 1
                continue
            out = b""
            for p in ps:
                if type(p) is int:
                    out += p.to_bytes(4, "little")
                elif p:
                    out += raw[at[k] : at[k + 1]]
                    k += 1
            self.memo[w] = out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = {w for t in texts for w in t.split() if w not in memo}
        if new:
            self.learn(list(new))
        return [b"".join(map(memo.__getitem__, t.split())) for t in texts]

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Codec] = {}


def _codec(content: bytes) -> Codec:
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(content)
    return _loaded[key]


def encode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True, digests: bool = True) -> DataFrame:
    """docs with n_tokens and, as asked for: `ids` (array<int>), `decoded` (string), and digests ids_sha256 and decoded_sha256."""
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary, of fixed size
    extra = [("n_tokens", "bigint"), *[("ids", "array<int>")] * ids, *[("decoded", "string")] * decoded, *[("ids_sha256", "string"), ("decoded_sha256", "string")] * digests]

    plain = docs.drop(*(n for n, _ in extra))
    raw = spare(plain, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in by_bytes(batches, raw, BATCH_BYTES):
            i = batch.schema.get_field_index(raw)
            coded = codec.encode([t or b"" for t in batch.column(i).to_pylist()])
            out = [pa.array([len(c) // 4 for c in coded], pa.int64())]
            if ids:
                flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)), pa.array(flat)))
            texts = [codec.decode(c) for c in coded] if decoded or digests else []
            if decoded:
                out.append(pa.array([t.decode() for t in texts], pa.string()))
            if digests:
                out += [pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (coded, texts)]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != i), *out], [*(c for c in batch.schema.names if c != raw), *(n for n, _ in extra)])
        codec.memo.clear()  # what the next task of this worker needs may be another's

    return plain.withColumn(raw, F.col("text").cast("binary")).mapInArrow(run, schema_of(plain, *extra))
