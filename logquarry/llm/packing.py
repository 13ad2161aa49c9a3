"""Packing by power-of-two decomposition.

A document's token ids (with the end id) are cut into pieces whose lengths are powers of two, at most
max_length: whole pieces of max_length first, then the binary digits of the rest from the largest down.
Pieces of one length form a bucket, every piece is a sequence of its own, so no sequence crosses
documents and none needs padding. Sequence ids are gapless over the whole table: bucket by bucket, the
longest first.

Null and empty texts: only the end id. Repeated rows are packed as rows of their own; a null doc_id stays null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import text_bytes, written

#: Words kept between batches; bounds a worker's memory, never the result.
KNOWN = 400_000
#: Longer words are encoded anew each time.
LONG_WORD = 64

# 1: ASCII letters and digits, 2: ASCII punctuation.
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(33, 127)]] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, word by word.

    The tokenizer's own split never joins characters over white space, nor a letter or digit with ASCII
    punctuation behind it, so a text's ids are those of its words in turn; each distinct word of a batch is
    encoded once, and the first KNOWN words are remembered. A word of Latin letters is one split of its own, and
    goes straight to the tokenizer's merges; all others take its whole path.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        if b"<|" in text:  # may hold the name of a special token, which has its own case and split
            return text.split()
        raw = np.frombuffer(text, np.uint8)
        kind = _KIND[raw]
        at = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
        return np.insert(raw, at, 32).tobytes().lower().split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get, known, rare, out = self.known.get, self.known, {}, []
        for text in texts:
            words = self.words(text)
            ids = list(map(get, words))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                w = words[at]
                found = known.get(w) or rare.get(w)
                if found is None:
                    found = self._encoded(w)
                    (known if len(known) < KNOWN and len(w) <= LONG_WORD else rare)[w] = found
                ids[at] = found
            out.append(b"".join(ids))
        return out

    def _encoded(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters only, lower-cased already
            ids = [t.id for t in self.merges.tokenize(word.decode().lower())]
        else:
            text = word.decode()
            if text.isalpha() and max(text) <= "\u017f" and "\u0130" not in text:  # composed letters with a plain lower case
                ids = [t.id for t in self.merges.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def piece_lengths(n: int, max_length: int) -> list[int]:
    """Powers of two that add up to n, largest first; max_length is a power of two."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def slices(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of a few MB each, a longer text by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    ship_package(docs.sparkSession)
    end = struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("place", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, counts = TaskContext.get().partitionId(), {}
        encoder = _encoder(tokenizer_path)
        for b in batches:
            texts, doc_ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lo, hi in slices(texts):
                cols = [[] for _ in schema]
                for doc, ids in zip(doc_ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start = 0
                    for length in piece_lengths(n, max_length):
                        place = counts.get(length, 0)
                        counts[length] = place + 1
                        piece = ids[4 * start : 4 * (start + length)]
                        row = [doc, start, length, zlib.crc32(piece), n, part, place]
                        if with_ids:
                            row.append(list(struct.unpack(f"<{length}I", piece)))
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    pieces = written(rows.mapInArrow(run, ddl))
    # A task's pieces of one length are numbered from 0; what comes before them is summed over (length, task).
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    bucket = counts.groupBy("length").agg(F.sum("n").alias("n"))
    base = bucket.select("length", (F.sum("n").over(W.orderBy(F.desc("length"))) - F.col("n")).alias("base"))  # a row a power of two
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    first = counts.select("length", "part", before.alias("before")).join(base, "length").select("length", "part", (F.col("base") + F.col("before")).alias("first"))
    numbered = pieces.join(first, ["length", "part"])
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
