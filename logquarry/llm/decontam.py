"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared as UTF-8 bytes with A-Z lower-cased and runs of blanks as one space. An item of
n bytes may occur with e = floor(n * error) edits. By the q-gram lemma such an occurrence shares at least
n - q + 1 - q e q-grams with the item, and their diagonals (text place less item place) differ by at most e; so
shared q-grams are counted in overlapping diagonal bands of width 2 (e + 1), bands below the bound are dropped,
and each remaining region is verified by an alignment kept within its band. Long texts are counted in overlapping
slices, and the shared q-grams of a slice at most PAIRS at a time, so memory follows the number of bands.

Where the bound is not above zero (items of 13 to 15 bytes, and higher error rates), one of e + 1 parts of the item
occurs unedited; every occurrence of a part names a band. An item of under q bytes is looked for as whole words,
unedited, and reported at its first place.

The items are the stated query set: they travel to the workers in blocks of at most BLOCK_BYTES, every block
against all documents. One block is a column of the documents' own scan; of several, each is a job of its own, whose
regions are written before the next begins. Null and empty texts have no regions, null and empty items none either.
Repeated rows are judged each; equal items are reported each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import doc_key, text_bytes, written

Q = 8
ERROR = 0.08
BLOCK_BYTES = 4 << 20
BITS = 22
#: Bytes of a text, beyond the longest item, whose q-grams are counted together; and shared q-grams listed at once.
SLICE, PAIRS = 1 << 16, 1 << 18
REGIONS_DDL = "array<struct<item_id:long,start:long,stop:long,distance:int>>"


def normal(raw: bytes) -> bytes:
    return b" ".join(raw.lower().split())


def grams(data: np.ndarray) -> np.ndarray:
    """The 8-byte q-grams of a byte array as numbers."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, strides=(1,))


def _slot(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


@dataclass
class Index:
    ids: list[int]
    items: list[bytes]
    error: float = ERROR

    def __post_init__(self):
        lengths = np.array([len(t) for t in self.items], np.int64)
        self.edits = np.floor(lengths * self.error).astype(np.int64)
        self.least = lengths - Q + 1 - Q * self.edits
        self.by_words = np.flatnonzero(lengths < Q).tolist()
        self.by_parts = np.flatnonzero((lengths >= Q) & (self.least < 1)).tolist()
        self.room = int(max((lengths + self.edits).max(initial=0), Q))
        codes, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(self.least >= 1).tolist():
            g = grams(np.frombuffer(self.items[i], np.uint8)) if lengths[i] >= Q else np.empty(0, np.uint64)
            codes.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        code, self.item, self.place = code[order], np.concatenate(item)[order], np.concatenate(place)[order]
        self.codes, self.first, self.count = np.unique(code, return_index=True, return_counts=True)
        self.listed = np.zeros(1 << BITS, bool)
        self.listed[_slot(self.codes)] = True

    def bands(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of bands that meet the bound, in slices that hold any occurrence whole."""
        found: set[tuple[int, int, int]] = set()
        step = max(SLICE, self.room)
        for start in range(0, max(len(text) - Q + 1, 1), step):
            found.update(self._slice_bands(text[start : start + step + self.room], start))
        return sorted(found)

    def _slice_bands(self, text: np.ndarray, start: int) -> Iterator[tuple[int, int, int]]:
        codes = grams(text)
        at = np.flatnonzero(self.listed[_slot(codes)])
        if not len(at) or not len(self.codes):
            return
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        found = self.codes[k] == codes[at]
        at, k = at[found], k[found]
        ends = np.cumsum(self.count[k])
        keys, counts, low = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while low < len(at):  # some q-grams of the text at a time, summed by band
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
            n = self.count[k[low:high]]
            where = np.repeat(self.first[k[low:high]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item = self.item[where]
            slab = (np.repeat(at[low:high] + start, n) - self.place[where]) // (self.edits[item] + 1) + (1 << 40)  # may be below zero at a text's start
            both = np.concatenate([keys, (item << 42) | slab])
            keys, index = np.unique(both, return_inverse=True)
            counts = np.bincount(index.reshape(-1), weights=np.concatenate([counts, np.ones(len(item), np.int64)])).astype(np.int64)
            low = high
        if not len(keys):
            return
        # Two neighbouring slabs make a band: diagonals that differ by at most e lie in one of them.
        nxt = np.append(np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0), 0)
        for j in np.flatnonzero(counts + nxt >= self.least[keys >> 42]).tolist():
            i, s = int(keys[j] >> 42), int(keys[j] & ((1 << 42) - 1)) - (1 << 40)
            w = int(self.edits[i]) + 1
            yield i, s * w, (s + 2) * w - 1

    def _part_bands(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """Bands of the items without a bound: around each occurrence of one of their parts."""
        for i in self.by_parts:
            item, e = self.items[i], int(self.edits[i])
            edges = [round(len(item) * j / (e + 1)) for j in range(e + 2)]
            for a, z in zip(edges, edges[1:], strict=False):
                at = text.find(item[a:z]) if z > a else -1
                while at >= 0:
                    yield i, at - a - e, at - a + e
                    at = text.find(item[a:z], at + 1)

    def regions(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, start, stop, distance) of verified occurrences in a normalised text; overlapping ones of an item once, the nearest."""
        best: dict[int, set[tuple[int, int, int]]] = {}
        for i, low, high in [*self.bands(np.frombuffer(text, np.uint8)), *self._part_bands(text)]:
            hit = align(self.items[i], text, low, high, int(self.edits[i]))
            if hit:
                best.setdefault(i, set()).add(hit)
        out = []
        for i, hits in best.items():
            taken: list[tuple[int, int, int]] = []  # by place; none overlaps another
            for d, a, b in sorted(hits):
                j = bisect_left(taken, (a, b, d))
                if (not j or taken[j - 1][1] <= a) and (j == len(taken) or taken[j][0] >= b):
                    taken.insert(j, (a, b, d))
            out += [(self.ids[i], a, b, d) for a, b, d in taken]
        spaced = b" " + text + b" " if self.by_words else b""
        for i in self.by_words:
            at = spaced.find(b" " + self.items[i] + b" ")
            if at >= 0:
                out.append((self.ids[i], at, at + len(self.items[i]), 0))
        return sorted(out, key=lambda r: (r[0], r[1]))


def align(item: bytes, text: bytes, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, stop) of the best occurrence of the whole item on diagonals low..high, widened by the edits."""
    low, high = low - edits, high + edits
    exact = text.find(item, max(low, 0), max(high, 0) + len(item))
    if exact >= 0:
        return 0, exact, exact + len(item)
    width = high - low + 1
    raw = np.frombuffer(text, np.uint8)
    far = np.int64(1 << 20)
    step = np.arange(width)
    # cell d of row i: i bytes of the item against the text up to place i + low + d
    ends = low + step
    row = np.where((ends >= 0) & (ends <= len(raw)), 0, far)
    start = np.clip(ends, 0, len(raw)).astype(np.int64)
    for i in range(1, len(item) + 1):
        ends = i + low + step
        inside = (ends >= 1) & (ends <= len(raw))
        same = np.zeros(width, bool)
        same[inside] = raw[ends[inside] - 1] == item[i - 1]
        value = np.where(inside, row + ~same, far)
        source = start
        skip = np.append(row[1:], far) + 1  # an item byte without a text byte: the diagonal above
        above = np.append(start[1:], 0)
        take = (skip < value) & (ends >= 0) & (ends <= len(raw))
        value, source = np.where(take, skip, value), np.where(take, above, source)
        level = value - step  # text bytes without an item byte: the best so far, one more each
        low_at = np.maximum.accumulate(np.where(level == np.minimum.accumulate(level), step, -1))
        gap = value[low_at] + step - low_at
        fill = (gap < value) & inside
        row, start = np.where(fill, gap, value), np.where(fill, source[low_at], source)
    d = int(row.argmin())
    if row[d] > edits:
        return None
    return int(row[d]), int(start[d]), len(item) + low + d


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """The items in blocks of a bounded size; only one block is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), text_bytes().alias("text")).orderBy("item_id").toLocalIterator()
    ids: list[int] = []
    items: list[bytes] = []
    size = 0
    for r in rows:
        t = normal(bytes(r["text"]))
        if not t:
            continue
        if size and size + len(t) > most:
            yield ids, items
            ids, items, size = [], [], 0
        ids.append(r["item_id"])
        items.append(t)
        size += len(t)
    if items:
        yield ids, items


def with_regions(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, name: str = "regions") -> DataFrame:
    """docs with an array of (item_id, start, stop, distance): places in the normalised text."""
    ship_package(docs.sparkSession)
    blocks = item_blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)

    def column(block):
        return F.pandas_udf(_finder(*block, error), REGIONS_DDL).asNondeterministic()(text_bytes())

    if second is None:
        return docs.withColumn(name, column(first) if first else F.array().cast(REGIONS_DDL))
    keys = {"__doc": doc_key(), "__mark": F.xxhash64(text_bytes())}  # rows equal in both have the same regions
    texts, found = docs.select("doc_id", "text").withColumns(keys), []
    for block in chain((first, second), blocks):
        rows = texts.select("__doc", "__mark", column(block).alias("r")).where(F.size("r") > 0)
        found.append(written(rows.select("__doc", "__mark", F.explode("r").alias("r"))))
    every = reduce(DataFrame.unionByName, found).distinct().groupBy("__doc", "__mark").agg(F.array_sort(F.collect_list("r")).alias("__r"))
    out = docs.drop(name).withColumns(keys).join(every, ["__doc", "__mark"], "left").withColumn(name, F.coalesce("__r", F.array().cast(REGIONS_DDL)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], name)


def _finder(ids: list[int], items: list[bytes], error: float):
    names = ("item_id", "start", "stop", "distance")

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(ids, items, error)
        for t in texts:
            rows = [[dict(zip(names, r, strict=True)) for r in index.regions(normal(x))] for x in t]
            yield pd.Series(rows, index=t.index, dtype=object)

    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """One row a verified region: doc_id, item_id, start, stop, distance."""
    found = with_regions(docs.select("doc_id", "text"), benchmark, error).where(F.size("regions") > 0)
    return found.select("doc_id", F.explode("regions").alias("r")).select("doc_id", "r.*")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """The documents without any region, all their columns unchanged."""
    return with_regions(docs, benchmark, error, "__regions").where(F.size("__regions") == 0).drop("__regions")
