"""MPEG audio columns: write, parse, verify and index streams.

parse() works on any bytes: it skips ID3v2 tags and an ID3v1 trailer (128 bytes that no frame covers), resynchronises on frame headers (a
header counts if the next frame, or the end, follows it), reads Xing/Info and VBRI tables, checks the CRC-16
of protected Layer III frames, and gives the exact duration in samples with the byte offset of each frame.
carry() stores a payload losslessly as the ancillary bytes of valid, silent, protected MPEG-1 Layer III
frames of 48 kHz: 576 payload bytes a frame of 672 bytes, after an ID3v2 tag and an Info frame.

Null and empty texts: one frame of padding. Very long texts: work and memory follow the text's length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import text_bytes
from .packing import slices

UNIT = 576
PAD = 255

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by bit-rate index 1-14, Hz by index.
RATES_V1 = {
    1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES_V2 = {
    1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    length: int  # bytes of the frame
    samples: int

    @property
    def side_bytes(self) -> int:
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The header in 32 bits, or None; free-format and reserved values are no headers."""
    if word not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[word] = _header(word)
    return _headers[word]


def _header(word: int) -> Header | None:
    version = {0: 25, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate, hz = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or rate in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    kbps = (RATES_V1 if version == 1 else RATES_V2)[layer][rate - 1]
    hertz = HERTZ[hz] // {1: 1, 2: 2, 25: 4}[version]
    padding = word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    slot = 4 if layer == 1 else 1
    length = (samples * kbps * 125 // hertz // slot + padding) * slot
    return Header(version, layer, not word >> 16 & 1, kbps, hertz, word >> 6 & 3 == 3, length, samples)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """Polynomial 8005 hex, start FFFF hex, high bit first."""
    if (got := _crcs.get(data)) is None:
        got = 0xFFFF
        for x in data:
            got = (got << 8 ^ _CRC[got >> 8 ^ x]) & 0xFFFF
        if len(_crcs) > 4096:
            _crcs.clear()
        _crcs[data] = got
    return got


@dataclass
class Parsed:
    tags: list[str] = field(default_factory=list)
    vbr: dict | None = None
    frames: list[tuple[int, Header]] = field(default_factory=list)  # audio frames by byte offset
    skipped: int = 0  # bytes passed over to find the next frame
    crc_checked: int = 0
    crc_bad: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for _, h in self.frames)

    @property
    def duration(self) -> Fraction:
        """Seconds, exact; rates may change between frames."""
        per: dict[int, int] = {}
        for _, h in self.frames:
            per[h.hertz] = per.get(h.hertz, 0) + h.samples
        return sum((Fraction(n, hz) for hz, n in per.items()), Fraction(0))


def _id3_size(data: bytes, at: int) -> int:
    size = 0
    for x in data[at + 6 : at + 10]:
        size = size << 7 | x & 127
    return 10 + size + (10 if data[at + 5] & 16 else 0)


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    for body in {at + 4 + h.side_bytes, at + 4 + 2 * h.protected + h.side_bytes}:
        if data[body : body + 4] in (b"Xing", b"Info"):
            kind, flags = data[body : body + 4].decode(), int.from_bytes(data[body + 4 : body + 8])
            out, p = {"kind": kind, "frames": None, "bytes": None, "toc": None}, body + 8
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit and p + size <= len(data):
                    raw = data[p : p + size]
                    out[name], p = list(raw) if name == "toc" else int.from_bytes(raw), p + size
            return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        _, _, _, size, frames, n, scale, width, each = struct.unpack(">HHHIIHHHH", data[at + 40 : at + 62])
        raw = data[at + 62 : at + 62 + n * width]
        toc = [int.from_bytes(raw[i : i + width]) * scale for i in range(0, len(raw), width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "each": each}
    return None


def parse(data: bytes) -> Parsed:
    out, at, end, first, synced = Parsed(), 0, len(data), True, False
    tail = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    while at < end:
        if at == tail:
            out.tags.insert(0, "ID3v1")
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end and not synced:
            out.tags.append(f"ID3v2.{data[at + 3]}")
            at += _id3_size(data, at)
            continue
        h = header(int.from_bytes(data[at : at + 4])) if at + 4 <= end else None
        fits = h is not None and at + h.length <= end
        over = fits and at < tail < at + h.length  # 'TAG' inside a frame is no trailer, unless the frame is a cut one
        if fits and (over or not synced) and at + h.length != tail and at + h.length + 4 <= end:  # a chance match has no second header behind it
            fits = header(int.from_bytes(data[at + h.length : at + h.length + 4])) is not None
        if over and end - 4 < at + h.length < end:
            fits = False
        if not fits:
            stop = tail if at < tail else end
            nxt = data.find(b"\xff", at + 1, stop)
            nxt = stop if nxt < 0 else nxt
            tag = data.find(b"ID3", at + 1, nxt)
            nxt = tag if tag >= 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        if h.protected and h.layer == 3:
            out.crc_checked += 1
            out.crc_bad += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side_bytes]) != int.from_bytes(data[at + 4 : at + 6])
        vbr = _vbr(data, at, h) if first and h.layer == 3 else None
        first, synced = False, True
        if vbr:
            out.vbr = vbr
        else:
            out.frames.append((at, h))
        at += h.length
    return out


# Header of the carrying frames: MPEG-1 Layer III, protected, 224 kbit/s, 48 kHz, stereo.
CARRIER = 0xFFFAC400
SIDE = bytes(32)  # no main data and empty granules: the frame is silent, the rest of it ancillary
BODY = 4 + 2 + len(SIDE)


def _frame_start() -> bytes:
    word = CARRIER.to_bytes(4)
    return word + crc16(word[2:] + SIDE).to_bytes(2) + SIDE


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    n = max(unit, -(-len(raw) // unit) * unit)
    return raw + bytes([PAD]) * (n - len(raw))


def carry(payload: bytes) -> bytes:
    """An MPEG stream that holds the payload, a positive multiple of UNIT bytes."""
    h = header(CARRIER)
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, h.length), np.uint8)
    start = _frame_start()
    frames[:, : len(start)] = np.frombuffer(start, np.uint8)
    frames[1:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    size = frames.size
    toc = bytes(min(255, (i * (n + 1) // 100) * h.length * 256 // size) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, size) + toc
    frames[0, BODY : BODY + len(info)] = np.frombuffer(info, np.uint8)
    body = b"\x00payload"
    tag = b"TIT2" + struct.pack(">IH", len(body), 0) + body
    return b"ID3\x03\x00\x00" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag + frames.tobytes()


def carried(data: bytes, parsed: Parsed) -> bytes:
    """The payload of a stream that carry() made, found by the parsed frame offsets."""
    if not parsed.frames:
        return b""
    offsets = np.array([at for at, _ in parsed.frames])
    raw = np.frombuffer(data, np.uint8)
    if (np.diff(offsets) == parsed.frames[0][1].length).all():
        a, step = offsets[0], parsed.frames[0][1].length
        return np.ascontiguousarray(raw[a : a + step * len(offsets)].reshape(-1, step)[:, BODY : BODY + UNIT]).tobytes()
    return b"".join(data[at + BODY : at + BODY + UNIT] for at in offsets.tolist())


def features(parsed: Parsed) -> str:
    d = parsed.duration
    rates = sorted({h.hertz for _, h in parsed.frames})
    kbps = sorted({h.kbps for _, h in parsed.frames})
    return (
        f"frames={len(parsed.frames)};samples={parsed.samples};seconds={d.numerator}/{d.denominator};hz={','.join(map(str, rates))};kbps={','.join(map(str, kbps))}"
        f";tags={','.join(parsed.tags)};vbr={parsed.vbr['kind'] if parsed.vbr else 'none'}:{parsed.vbr['frames'] if parsed.vbr else 0};crc={parsed.crc_checked - parsed.crc_bad}/{parsed.crc_checked};skipped={parsed.skipped}"
    )


PARSED_DDL = "frames long, samples long, seconds_num long, seconds_den long, crc_checked long, crc_bad long, skipped long, tags array<string>, vbr string, seek_offsets array<long>"


def parse_column(df: DataFrame, column: str = "media") -> DataFrame:
    """Adds a struct `mpeg` of what parse() finds in a binary column; null bytes are parsed as none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for data in pdf[column]:
                p = parse(bytes(data or b""))
                rows.append((len(p.frames), p.samples, p.duration.numerator, p.duration.denominator, p.crc_checked, p.crc_bad, p.skipped, p.tags, p.vbr and p.vbr["kind"], [at for at, _ in p.frames]))
            names = [x.split()[0] for x in PARSED_DDL.split(", ")]
            yield pdf.assign(mpeg=[dict(zip(names, r, strict=True)) for r in rows])

    from pyspark.sql import types as T

    ship_package(df.sparkSession)
    out = T.StructType([*df.schema.fields, T.StructField("mpeg", T.StructType.fromDDL(PARSED_DDL))])
    return df.mapInPandas(run, out)


DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets array<long>"


def digest(docs: DataFrame) -> DataFrame:
    """Each document's text carried in an MPEG stream, read back from it, with the stream's features."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("seek_offsets", pa.list_(pa.int64()))])

    def row(doc, raw: bytes) -> tuple:
        payload = padded(raw)
        media = carry(payload)
        parsed = parse(media)
        back = carried(media, parsed)
        if back != payload:
            raise ValueError(f"document {doc}: read back {len(back)} bytes that are not its payload of {len(payload)}")
        return doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(parsed), [at for at, _ in parsed.frames]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                rows = [row(d, t) for d, t in zip(ids[lo:hi], texts[lo:hi], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, DIGEST_DDL)
