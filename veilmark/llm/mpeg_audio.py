"""MPEG audio columns: writing byte payloads as Layer III streams, and a frame parser.

`store` writes a text's UTF-8 bytes, padded with bytes 255 to a positive
multiple of `UNIT`, as the main data of Layer III frames, `UNIT` bytes a frame,
at a bitrate that varies, with checksums, an ID3v2 tag and a table of seek
points (Xing) up front. The data is no music; the stream's structure is what
any MPEG parser walks.

`parse` takes any stream of MPEG 1, 2 or 2.5, Layer I, II or III: it skips and
reads ID3v2 and ID3v1 tags, resynchronises (a header counts only if another
fitting header, a tag or the end follows its frame), reads Xing, Info and VBRI
tables and the encoder's delay and padding in them, verifies the CRC-16 of
protected frames (over the last two header bytes and the side information; of
Layer I the bit allocation; of Layer II the bit allocation and the scale factor
selection), follows frames of free bitrate, whose size is the distance to the
next like header, and gives exact durations as fractions of seconds, less delay
and padding, and each frame's byte offset.

Null texts are empty ones: a payload of one unit. Null media give no frames.
Damaged bytes are skipped and counted. Very long media are walked whole, one at
a time if need be. Rows are handled one by one, so copies, ties, repeated rows
and ids and further columns pass through; the columns that a function adds are
overwritten. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import by_bytes, schema_of, small_batches, spare

UNIT = 576
BATCH_BYTES = 4 << 20
#: Fixed values of the format: kbit/s by index, for MPEG 1 layers I, II, III, then MPEG 2 layers I, and II and III.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by index, for MPEG 1; MPEG 2 has the half of each, 2.5 a quarter.
HZ = (44100, 48000, 32000)
#: Every eighth frame is a size larger.
_PLAIN, _LARGE = 12, 13
_SIDE = 17  # bytes of side information: MPEG 1, one channel


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, bits: int = 0) -> int:
    """Of whole bytes, and of so many of the first bits of one more."""
    c = 0xFFFF
    for b in data[: len(data) - (bits > 0)]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for k in range(bits):
        out = c >> 15 ^ data[-1] >> 7 - k & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if out else 0)
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbits: int
    hz: int
    channels: int
    size: int  # 0: free bitrate
    samples: int
    bound: int  # sub-bands with an allocation for each channel

    @property
    def side(self) -> int:
        """Bytes that the checksum covers after the header."""
        if self.layer == 3:
            return {(True, 1): 17, (True, 2): 32, (False, 1): 9, (False, 2): 17}[self.version == 1, self.channels]
        return 0


def read_header(raw: bytes) -> Header | None:
    """The header that four bytes hold, if they hold one with a known bitrate."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or rate == 15 or hz == 3:
        return None
    kbits = KBITS[1 if version == 1 else 2, layer][rate]
    hertz = HZ[hz] // {1: 1, 2: 2, 25: 4}[version]
    pad = raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    mode = raw[3] >> 6
    return Header(version, layer, not raw[1] & 1, kbits, hertz, 1 if mode == 3 else 2, size if rate else 0, samples, {1: (raw[3] >> 4 & 3) * 4 + 4, 3: 0}.get(mode, 32))


def _widths(h: Header) -> list[int]:
    """Bits of the allocation of each sub-band, Layer I and II. Fixed values of the format."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbits // h.channels or 192  # free bitrates use the widest table
    if each < 56:
        return [4] * 2 + [3] * (10 if h.hz == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and h.hz != 48000 else 4)


def checked(raw: bytes, at: int, h: Header) -> tuple[bytes, int]:
    """What the checksum of a Layer I or II frame covers, as bytes and the bits that count of the last one."""
    body, widths = int.from_bytes(raw[at + 6 : at + 6 + 64], "big"), _widths(h)
    total = 8 * len(raw[at + 6 : at + 6 + 64])
    bits = used = 0
    for band, width in enumerate(widths):
        for _ in range(2 if band < h.bound and h.channels == 2 else 1):
            if body >> max(total - bits - width, 0) & (1 << width) - 1:
                used += 1 if band < h.bound or h.channels == 1 else 2  # scale factor selections that follow
            bits += width
    bits += 2 * used * (h.layer == 2)
    return raw[at + 2 : at + 4] + raw[at + 6 : at + 6 + -(-bits // 8)], bits % 8


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of audio frames
    sizes: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # of their main data
    samples: int = 0
    duration: Fraction = Fraction(0)
    crc_bad: int = 0
    crc_checked: int = 0
    skipped: int = 0
    version: int = 0
    layer: int = 0
    hz: int = 0
    kbits: set[int] = field(default_factory=set)
    table: str = ""  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    delay: int = 0  # samples that the encoder put before the sound
    padding: int = 0  # and after it
    toc: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)


def _id3v2(raw: bytes, at: int, out: Stream) -> int:
    """Reads a tag that starts here; returns where it ends."""
    size = 10 + sum((raw[at + 9 - k] & 0x7F) << 7 * k for k in range(4)) + (10 if raw[at + 5] & 0x10 else 0)
    major, p, end = raw[at + 3], at + 10, min(at + size, len(raw))
    while major in (3, 4) and p + 10 <= end and raw[p]:
        n = sum((raw[p + 7 - k] & 0x7F) << 7 * k for k in range(4)) if major == 4 else int.from_bytes(raw[p + 4 : p + 8])
        body = raw[p + 10 : min(p + 10 + n, end)]
        if raw[p : p + 1] == b"T" and body:
            out.tags[raw[p : p + 4].decode("latin-1")] = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
        p += 10 + n
    return end


def _table(raw: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether this frame is a table of a variable bitrate, not audio."""
    p = at + 4 + 2 * h.protected + h.side
    name = raw[p : p + 4]
    if name in (b"Xing", b"Info"):
        flags, p = int.from_bytes(raw[p + 4 : p + 8]), p + 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(raw[p : p + 4]), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(raw[p : p + 4]), p + 4
        if flags & 4:
            out.toc, p = list(raw[p : p + 100]), p + 100
        p += 4 if flags & 8 else 0
        if raw[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= at + h.size:  # delay and padding, 12 bits each
            both = int.from_bytes(raw[p + 21 : p + 24])
            out.delay, out.padding = both >> 12, both & 0xFFF
        out.table = name.decode()
        return True
    p = at + 36
    if raw[p : p + 4] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(raw[p + 10 : p + 14]), int.from_bytes(raw[p + 14 : p + 18])
        entries, scale, width = (int.from_bytes(raw[p + k : p + k + 2]) for k in (18, 20, 22))
        out.toc = [int.from_bytes(raw[p + 26 + k * width : p + 26 + (k + 1) * width]) * scale for k in range(entries)]
        return True
    return False


def parse(raw: bytes) -> Stream:
    """Walks a whole stream."""
    out, at, end = Stream(), 0, len(raw)
    headers: dict[bytes, Header | None] = {}
    sums: dict[bytes, int] = {}
    spans: dict[int, int] = {}  # samples by rate

    free: dict[tuple, int] = {}  # size without padding of frames of free bitrate

    def header(p: int) -> Header | None:
        key = raw[p : p + 4]
        if key not in headers:
            headers[key] = read_header(key)
        h = headers[key]
        if h is None or h.size:
            return h
        same, pad, slot = (key[1], key[2] & 0xFC, key[3] >> 6 == 3), key[2] >> 1 & 1, 4 if h.layer == 1 else 1
        if same not in free:
            q = raw.find(key[:2], p + 24, p + 8192)
            while q >= 0 and (q + 4 > end or (raw[q + 2] & 0xFC, raw[q + 3] >> 6 == 3) != same[1:]):
                q = raw.find(key[:2], q + 1, p + 8192)
            if q < 0:
                return None
            free[same] = q - p - pad * slot
        return replace(h, size=free[same] + pad * slot)

    if raw[-128:-125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", raw[end + 3 : end + 33].decode("latin-1").rstrip("\0 "))
    follows = lambda p, h: p == end or raw[p : p + 3] == b"ID3" or (n := header(p)) is not None and (n.version, n.layer, n.hz) == (h.version, h.layer, h.hz)
    synced, tag = False, 0
    while at < end:
        if raw[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(raw, at, out)
            continue
        h = header(at)
        if h is None or at + h.size > end or not (synced or follows(at + h.size, h)):
            if tag <= at:
                tag = raw.find(b"ID3", at + 1, end) % (end + 1)  # no tag ahead: the end
            nxt = min(tag, raw.find(b"\xff", at + 1, end) % (end + 1))
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = follows(at + h.size, h)  # else the next frame must prove itself
        if h.protected:
            key, bits = (raw[at + 2 : at + 4] + raw[at + 6 : at + 6 + h.side], 0) if h.layer == 3 else checked(raw, at, h)
            if key not in sums:
                sums[key] = crc16(key, bits)
            out.crc_checked += 1
            out.crc_bad += sums[key] != int.from_bytes(raw[at + 4 : at + 6])
        if out.offsets or out.table or not (h.layer == 3 and _table(raw, at, h, out)):
            out.offsets.append(at)
            out.sizes.append(h.size)
            out.starts.append(at + 4 + 2 * h.protected + (h.side if h.layer == 3 else 0))
            out.samples += h.samples
            out.kbits.add(h.kbits)
            spans[h.hz] = spans.get(h.hz, 0) + h.samples
            out.version, out.layer, out.hz = h.version, h.layer, h.hz
        at += h.size
    out.duration = max(sum((Fraction(n, hz) for hz, n in spans.items()), Fraction(0)) - (Fraction(out.delay + out.padding, out.hz) if out.hz else 0), Fraction(0))
    return out


def _frame(rate: int, body: bytes) -> bytes:
    """A protected frame of one channel at 48 kHz."""
    head = bytes([0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0])
    side = bytes(_SIDE)
    size = read_header(head).size
    return head + crc16(head[2:] + side).to_bytes(2) + side + body + bytes(size - 6 - _SIDE - len(body))


_STARTS = {r: _frame(r, b"")[: 6 + _SIDE] for r in (_PLAIN, _LARGE)}
_SIZES = {r: len(_frame(r, b"")) for r in (_PLAIN, _LARGE)}
_FILLS = {r: bytes(_SIZES[r] - 6 - _SIDE - UNIT) for r in (_PLAIN, _LARGE)}


def write(payload: bytes, title: str = "") -> bytes:
    """A stream whose frames hold the payload, UNIT bytes each; its length is a multiple of UNIT."""
    n = len(payload) // UNIT
    rates = [_LARGE if k % 8 == 7 else _PLAIN for k in range(n)]
    audio = b"".join([_STARTS[r] + payload[k * UNIT : k * UNIT + UNIT] + _FILLS[r] for k, r in enumerate(rates)])
    text = b"\x03" + title.encode()
    tag = b"TIT2" + len(text).to_bytes(4) + b"\0\0" + text
    size = len(tag)
    id3 = b"ID3\x03\0\0" + bytes(size >> 7 * k & 0x7F for k in (3, 2, 1, 0)) + tag
    ends = np.concatenate(([0], np.cumsum([_SIZES[r] for r in rates])))
    toc = bytes(np.minimum(255, ends[np.arange(100) * n // 100] * 256 // ends[-1]).astype(np.uint8))
    table = _frame(_PLAIN, b"Xing" + (7).to_bytes(4) + n.to_bytes(4) + (len(audio) + _SIZES[_PLAIN]).to_bytes(4) + toc)
    return id3 + table + audio


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def payload_of(raw: bytes, stream: Stream) -> bytes:
    return b"".join([raw[s : s + UNIT] for s in stream.starts])


def features(stream: Stream) -> str:
    offsets = np.array(stream.offsets, "<i8")
    d = stream.duration
    return (
        f"mpeg{stream.version}-l{stream.layer};hz={stream.hz};frames={len(offsets)};kbits={'/'.join(map(str, sorted(stream.kbits)))};seconds={d.numerator}/{d.denominator};"
        f"table={stream.table}:{stream.table_frames}:{stream.table_bytes};crc={stream.crc_checked - stream.crc_bad}/{stream.crc_checked};skipped={stream.skipped};seek_crc32={zlib.crc32(offsets.tobytes())}"
    )


def _mapped(df: DataFrame, column: str, extra: list[tuple[str, str]], make) -> DataFrame:
    """df with columns that `make` computes from the values of `column`, as bytes or None."""
    plain = df.drop(*(n for n, _ in extra))
    raw_name = spare(plain, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, raw_name, BATCH_BYTES):
            i = batch.schema.get_field_index(raw_name)
            made = list(zip(*map(make, batch.column(i).to_pylist()), strict=True)) or [[]] * len(extra)
            kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != i), *(pa.array(v, kinds[t]) for v, (_, t) in zip(made, extra, strict=True))], [*(c for c in batch.schema.names if c != raw_name), *(n for n, _ in extra)])

    small_batches(df.sparkSession)
    source = plain.withColumn(raw_name, F.col(column).cast("binary")).drop(column)
    return source.mapInArrow(run, schema_of(source.drop(raw_name), *extra))


def store(docs: DataFrame) -> DataFrame:
    """docs with n_bytes and media in place of text."""

    def make(raw: bytes | None) -> tuple:
        raw = raw or b""
        return len(raw), write(padded(raw), title=f"{len(raw)} bytes")

    return _mapped(docs, "text", [("n_bytes", "bigint"), ("media", "binary")], make)


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """Columns in place of the media: seconds as numerator and denominator, frame offsets, tag title, damage."""

    def make(raw: bytes | None) -> tuple:
        s = parse(raw or b"")
        return s.duration.numerator, s.duration.denominator, s.offsets, s.tags.get("TIT2"), s.crc_bad, s.skipped, features(s)

    return _mapped(media, column, [("seconds_num", "bigint"), ("seconds_den", "bigint"), ("frame_offsets", "array<bigint>"), ("title", "string"), ("crc_bad", "bigint"), ("skipped_bytes", "bigint"), ("feature", "string")], make)


def digests(media: DataFrame, column: str = "media") -> DataFrame:
    """Columns in place of the media, read back from it: payload and media sizes and digests, features, exact seconds, frame offsets."""

    def make(raw: bytes | None) -> tuple:
        raw = raw or b""
        s = parse(raw)
        payload = payload_of(raw, s)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), features(s), s.duration.numerator, s.duration.denominator, s.offsets

    return _mapped(media, column, [("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("seconds_num", "bigint"), ("seconds_den", "bigint"), ("frame_offsets", "array<bigint>")], make)
