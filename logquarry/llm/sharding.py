"""Sharding by a Feistel permutation of global row numbers.

Documents are numbered from 0 in the order of doc_id (then size and checksum). A keyed Feistel network
permutes 0..4^h-1, and numbers that land at or above the row count walk along their cycle until they land
below it, which gives a permutation of exactly the row numbers. Position p goes to shard p mod S, slot
p div S: shard counts differ by at most one, slots have no gaps, and both are computable from the row number
(and, by the inverse, the row number from shard and slot) without any lookup.

Null text: size 1, checksum of no bytes. Null doc_id: numbered first. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import mix64, text_bytes, with_row_numbers

ROUNDS = 6


def _network(x: np.ndarray, half: int, seed: int, back: bool = False) -> np.ndarray:
    """One pass of the balanced Feistel network over 2*half bits."""
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed))
    left, right = x >> np.uint64(half), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix64(left ^ k) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ k) & mask)
    return (left << np.uint64(half)) | right


def permute(numbers, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Where each number of 0..n-1 goes (or, back, came from): a permutation of 0..n-1 fixed by the seed."""
    half = max(1, round((max(n - 1, 1).bit_length() + 1) / 2))  # a half goes to the even number, as in the query's SQL
    x = _network(np.asarray(numbers, np.uint64), half, seed, back)
    out = np.flatnonzero(x >= n)
    while len(out):  # cycle walking; the domain is at most 8 n, so few steps are needed
        x[out] = _network(x[out], half, seed, back)
        out = out[x[out] >= n]
    return x.astype(np.int64)


def shard(docs: DataFrame, shards: int = 16, seed: int = 0x5EED) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of every document; law: row counts at most one apart."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_bytes()) + 1).cast("long").alias("size"),
        F.crc32(text_bytes()).alias("text_crc32"),
    )
    numbered = with_row_numbers(sized, ["doc_id", "size", "text_crc32"])
    total = numbered.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = permute(b.column(3).to_numpy(), total, seed)
            cols = [*b.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "shard", "slot"])

    ship_package(docs.sparkSession)
    return numbered.mapInArrow(run, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
