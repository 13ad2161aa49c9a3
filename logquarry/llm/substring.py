"""Substring dedup by De Bruijn compaction.

The k-mers (windows of k words) are the edges of a De Bruijn graph over the whole corpus. Each document is first cut
into super-k-mers: runs of consecutive k-mers that share their minimizer (the m-gram of least hash), so that equal
k-mers always meet under equal minimizers and a nonbranching stretch of a path travels as one row.

1. Minimizers that occur once hold no repeat; a join with those that occur more often keeps the other runs.
2. A run is a form of its minimizer. A join with the first place of each form makes every later one a repeat of it,
   whole. Where a minimizer has one form, the path through it does not branch, and its first run stays compact too;
   where it has several, the path branches, and a join with those minimizers opens the first run of each form.
3. Only opened runs become single k-mers, joined by their hash with the first place of each.
4. Repeats of one document that follow each other as their sources do compact to one path with one source.
5. Every path is verified at its source's coordinates: cut at every BLOCK words of the source, the words at each of the
   two places are read from the two texts and their digests (BLAKE2b, 128 bits) compared before anything is removed. If
   a single comparison fails (equal 64-bit hashes of other words), the whole run is done again with other hashes.

Every first place is a minimum that is combined on the map side, and every join has plain exchanges that the adaptive
skew join can split. Before each exchange a batch resolves its own repeats, so a passage that a third of all rows
share arrives as one row a batch, not one a document.

Rows: a null text has no words; a null doc_id sorts first. Texts under k words have no window. Rows equal in doc_id and
text are one document and lose the same; rows of one doc_id with other texts are documents of their own, in the order
of their texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import doc_key, from_doc_key, mix64, text_bytes, written
from .packing import slices

#: Words of a minimizer.
M = 5
#: Words of a block of a source, by which paths are verified.
BLOCK = 64
#: Text that is taken at once.
SLICE = 2 << 20
OPEN, REPEAT, SELF = 0, 1, 2  # a row still to be compared; settled; to be opened in any case
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    one = np.full(n + 1, base, np.uint64)
    back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    one[0] = back[0] = 1
    return np.cumprod(one), np.cumprod(back)


class Hashes:
    """Hashes of word runs of one slice of text: polynomials over 64-bit word hashes."""

    def __init__(self, words: np.ndarray, base: int):
        n = 1 << max(12, int(len(words)).bit_length())
        power, self.back = _powers(base, n)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(words * power[: len(words)])))

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        raw = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mix64(raw ^ (np.uint64(0xA0761D6478BD642F) * np.asarray(length, np.uint64)))


def word_hash(word: bytes, seed: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word, seed)


def word_hashes(texts: list[bytes], seed: int, hash_of: Callable[[bytes, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words start (with the end)."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    if hash_of is word_hash:
        from xxhash import xxh3_64_intdigest as known

        words = np.fromiter((known(w, seed) for ws in split for w in ws), np.uint64, int(counts.sum()))
    else:
        words = np.fromiter((hash_of(w, seed) for ws in split for w in ws), np.uint64, int(counts.sum()))
    return words, np.concatenate(([0], np.cumsum(counts)))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w numbers."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimizer hash, run hash, may repeat within itself) of every run."""
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(words) < k:
        return empty
    m = min(M, k)
    w = k - m + 1
    h = Hashes(words, BASES[0])
    grams = h.runs(np.arange(len(words) - m + 1), m)
    low = _sliding_min(grams, w)  # of the window at each place
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)[: len(low)]
    valid = np.arange(len(low)) + k <= starts[text + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return empty
    new = np.concatenate(([True], (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]]) | (text[at[1:]] != text[at[:-1]])))
    first = at[new]
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    # Equal windows inside one run need the minimizer to enter again after the run's first window.
    enters = (grams[at + w - 1] == low[at]) & ~new
    again = np.zeros(len(first), bool)
    again[run[enters]] = True
    content = Hashes(words, BASES[1]).runs(first, size + k - 1)
    return text[first], first - starts[text[first]], size, low[first], content, again


def settle(order: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For rows with equal `same` columns: which is the first in `order` (most significant first), and whether a row comes after it."""
    index = np.lexsort((*order[::-1], *same[::-1]))
    new = np.ones(len(index), bool)
    if len(index) > 1:
        new[1:] = np.logical_or.reduce([c[index[1:]] != c[index[:-1]] for c in same])
    first = np.empty(len(index), np.int64)
    first[index] = index[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first, np.logical_or.reduce([c != c[first] for c in order])


def compact(start: np.ndarray, n: np.ndarray, src_doc: np.ndarray, src_mark: np.ndarray, src_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paths (start, windows, source's doc, mark and start) of one document's repeats: those that go on as their source does are one."""
    order = np.lexsort((start, src_start - start, src_mark, src_doc))
    start, n, src_doc, src_mark, src_start = (x[order] for x in (start, n, src_doc, src_mark, src_start))
    same = (src_doc[1:] == src_doc[:-1]) & (src_mark[1:] == src_mark[:-1]) & (src_start[1:] - start[1:] == src_start[:-1] - start[:-1])
    line = np.concatenate(([0], np.cumsum(~same)))  # of one source and distance
    base = line * (int((start + n).max()) + 2)
    reach = np.maximum.accumulate(start + n + base)
    new = np.concatenate(([True], start[1:] + base[1:] > reach[:-1]))
    stop = np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1]) - base[new]
    return start[new], stop - start[new], src_doc[new], src_mark[new], src_start[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(where each row's list starts, with the end; each field of all lists' structs)."""
    flat = column.values
    return column.offsets.to_numpy(), [flat.field(j).to_numpy(zero_copy_only=False) for j in range(flat.type.num_fields)]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): mark tells rows of one doc_id with different texts apart, and is 0 where there are none."""
    keyed = docs.select(doc_key().alias("doc"), text_bytes().alias("text"))
    marked = keyed.select("doc", F.xxhash64("text").alias("mark")).groupBy("doc").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    several = written(marked.where("low <> high").select("doc"))
    if several.isEmpty():  # zero, but no literal: joins and groupings by (doc, mark) then share one exchange
        return keyed.select("doc", F.col("doc").bitwiseAND(F.lit(0).cast("long")).alias("mark"), "text")
    told = keyed.join(several.withColumn("several", F.lit(True)), "doc", "left")
    return told.select("doc", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("mark"), "text")


def packed_texts(keyed: DataFrame) -> DataFrame:
    """keyed with its texts compressed: they are shuffled once, and a shuffle's own codec leaves words as long as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([small.compress(t) for t in b.column(2).to_pylist()], pa.binary())], ["doc", "mark", "text"])

    ship_package(keyed.sparkSession)
    packed = keyed.mapInArrow(run, "doc long, mark long, text binary")
    return packed.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("doc", "mark")], "text")  # never null: joins add no filter, and share one exchange


def unpacked(texts: list[bytes]) -> list[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor()
    return [whole.decompress(t) for t in texts]


RUNS = "low long, content long, doc long, mark long, first int, size int, state byte, src_doc long, src_mark long, src_first int"
#: src_start is -1 for a k-mer that is not settled.
EDGES = "one long, doc long, mark long, start int, src_doc long, src_mark long, src_start int"
PIECES = "doc long, mark long, start int, length int, src_doc long, src_mark long, block int, offset int"


def _batch(ddl: str, *columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays([a.cast(types[t]) for a, (_, t) in zip(arrays, fields, strict=True)], [name for name, _ in fields])


def pieces(keyed: DataFrame, packed: DataFrame, k: int, seed: int, hash_of: Callable[[bytes, int], int]) -> DataFrame:
    """Words to remove, by places (PIECES): length words from start repeat those from offset of a block of the source.

    packed: keyed with compressed texts.

    A word is to be removed if a window over it holds the words of an earlier window: one of an earlier document, or
    of the same document at an earlier place.
    """
    ship_package(keyed.sparkSession)

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in slices(texts, SLICE):
                low = super_kmers(*word_hashes(texts[lo:hi], seed, hash_of), k)[3]
                low, n = np.unique(low, return_counts=True)
                yield _batch("low long, n long", _signed(low), n)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, marks, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for lo, hi in slices(texts, SLICE):
                text, first, size, low, content, again = super_kmers(*word_hashes(texts[lo:hi], seed, hash_of), k)
                doc, mark = docs[lo:hi][text], marks[lo:hi][text]
                source, later = settle((doc, mark, first), (low, content))
                state = np.where(later, REPEAT, np.where(again, SELF, OPEN))
                low = np.where(later, mix64(low ^ mix64(doc.view(np.uint64) ^ first.astype(np.uint64))), low)  # settled ones are spread
                told = [np.where(later, x[source], 0) for x in (doc, mark, first)]
                yield _batch(RUNS, _signed(low), _signed(np.where(later, np.uint64(0), content)), doc, mark, first, size, state, *told)

    counted = keyed.select("text").mapInArrow(lows, "low long, n long").groupBy("low").agg(F.sum("n").alias("n"))
    shared = written(counted.where("n > 1").select("low")).withColumn("shared", F.lit(True))
    rows = keyed.mapInArrow(runs, RUNS).join(shared, "low", "left")
    rows = written(rows.where(F.col("shared") | (F.col("state") != OPEN)).drop("shared"))

    live, at = rows.where(F.col("state") != REPEAT), F.struct("doc", "mark", "first")
    branching = live.groupBy("low").agg(F.min("content").alias("one"), F.max("content").alias("other")).where("one <> other").select("low", F.lit(True).alias("branches"))
    firsts = live.groupBy("content").agg(F.min(at).alias("source"))
    told = live.join(firsts, "content").join(branching, "low", "left")
    told = told.withColumn("state", F.when(at != F.col("source"), REPEAT).when(F.col("branches") | (F.col("state") == SELF), OPEN)).where("state is not null")
    told = written(told)
    source = [F.col(f"source.{c}").alias(f"src_{n}") for c, n in (("doc", "doc"), ("mark", "mark"), ("first", "start"))]
    whole = told.where(F.col("state") == REPEAT).select("doc", "mark", F.col("first").alias("start"), F.col("size").alias("n"), *source)
    settled = rows.where(F.col("state") == REPEAT).select("doc", "mark", F.col("first").alias("start"), F.col("size").alias("n"), "src_doc", "src_mark", F.col("src_first").alias("src_start"))
    wide = told.where(F.col("state") == OPEN).groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "size")).alias("runs"))  # a document's own

    def open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, marks, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), unpacked(b.column(2).to_pylist())
            offsets, fields = _lists(b.column(3))
            for lo, hi in slices(texts, SLICE):
                words, starts = word_hashes(texts[lo:hi], seed, hash_of)
                text = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
                first, size = (x[offsets[lo] : offsets[hi]].astype(np.int64) for x in fields)
                run = np.repeat(np.arange(len(first)), size)
                place = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
                text = text[run]
                one = Hashes(words, BASES[0]).runs(starts[text] + place, k)
                doc, mark = docs[lo:hi][text], marks[lo:hi][text]
                low, later = settle((doc, mark, place), (one,))
                told = [np.where(later, x[low], 0) for x in (doc, mark)] + [np.where(later, place[low], -1)]
                one = np.where(later, mix64(one ^ mix64(doc.view(np.uint64) ^ place.astype(np.uint64))), one)
                yield _batch(EDGES, _signed(one), doc, mark, place, *told)

    opened = packed.join(wide, ["doc", "mark"]).select("doc", "mark", "text", "runs").mapInArrow(open_runs, EDGES)
    # A batch names each k-mer once, so one k-mer has at most one row a slice of text, however many documents share it.
    is_settled = F.col("src_start") >= 0
    first = F.first(F.struct("doc", "mark", "start")).over(W.partitionBy("one", is_settled).orderBy("doc", "mark", "start"))
    edges = opened.withColumn("source", first).where(is_settled | (F.struct("doc", "mark", "start") != F.col("source")))
    own = [F.when(is_settled, F.col(f"src_{c}")).otherwise(F.col(f"source.{c}")).alias(f"src_{c}") for c in ("doc", "mark", "start")]
    edges = edges.select("doc", "mark", "start", F.lit(1).alias("n"), *own).unionByName(whole).unionByName(settled)
    repeats = edges.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n", "src_doc", "src_mark", "src_start")).alias("repeats"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, fields = _lists(b.column(2))
            for i, (doc, mark) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                own = slice(offsets[i], offsets[i + 1])
                start, n, src_doc, src_mark, src_start = compact(*(x[own].astype(np.int64) for x in fields))
                length = n + k - 1
                low, high = src_start // BLOCK, (src_start + length - 1) // BLOCK
                path = np.repeat(np.arange(len(start)), high - low + 1)
                block = low[path] + np.arange(len(path)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                a = np.maximum(block * BLOCK, src_start[path])
                z = np.minimum((block + 1) * BLOCK, (src_start + length)[path])
                yield _batch(PIECES, np.full(len(path), doc), np.full(len(path), mark), (start - src_start)[path] + a, z - a, src_doc[path], src_mark[path], block, a - block * BLOCK)

    return repeats.mapInArrow(paths, PIECES)


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def source_digests(packed: DataFrame, found: DataFrame) -> DataFrame:
    """(src_doc, src_mark, block, offset, length, digest) of the sources' words that pieces name."""
    ddl = "src_doc long, src_mark long, block int, offset int, length int, digest binary"
    names = ["src_doc", "src_mark", "block", "offset", "length"]
    wanted = F.collect_list(F.struct("block", "offset", "length"))  # parts of blocks: bounded by the source's own length
    needed = found.select(*names).distinct().groupBy(F.col("src_doc").alias("doc"), F.col("src_mark").alias("mark")).agg(wanted.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, marks, texts, lists = (c.to_pylist() for c in b.columns)
            rows = []
            for doc, mark, text, parts in zip(docs, marks, unpacked(texts), lists, strict=True):
                words = text.split()
                for p in parts:
                    start = p["block"] * BLOCK + p["offset"]
                    rows.append((doc, mark, p["block"], p["offset"], p["length"], digest(words[start : start + p["length"]])))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield _batch(ddl, *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types)))

    cuts = packed.join(needed, ["doc", "mark"]).select("doc", "mark", "text", "parts").mapInArrow(run, ddl)
    return cuts.groupBy(*names).agg(F.first("digest").alias("digest"))  # rows that are equal give theirs once


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, words removed, what is left, joined by one space)."""
    words = text.split()
    n = len(words)
    if not spans:
        return n, 0, b" ".join(words)
    left, end = [], 0
    for a, b in sorted(spans):
        if a > end:
            left += words[end:a]
        end = max(end, b)
    left += words[end:]
    return n, n - len(left), b" ".join(left)


def verified_spans(words: list[bytes], marks: list[dict]) -> list[tuple[int, int]] | None:
    """The spans of a document whose words are those at their source's coordinates; None if some are not."""
    if any(digest(words[m["start"] : m["start"] + m["length"]]) != m["digest"] for m in marks):
        return None
    return [(m["start"], m["start"] + m["length"]) for m in marks]


def _result(packed: DataFrame, found: DataFrame, with_text: bool) -> DataFrame:
    checked = found.join(source_digests(packed, found), ["src_doc", "src_mark", "block", "offset", "length"], "left")
    cuts = checked.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "length", "digest")).alias("cuts"))
    ddl = "doc long, n_words long, n_removed long, kept_sha256 string, verified boolean" + ", kept string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, marks in zip(unpacked(b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                spans = verified_spans(text.split(), marks) if marks else []
                n, gone, kept = kept_words(text, spans or [])
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), spans is not None, *[kept.decode("utf-8", "replace")] * with_text))
            types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            cols = [pa.array([r[j] for r in rows], types[j]) for j in range(4 + with_text)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc", "n_words", "n_removed", "kept_sha256", "verified", "kept"][: 5 + with_text])

    return packed.join(cuts, ["doc", "mark"], "left").select("doc", "text", "cuts").mapInArrow(cut, ddl)


def dedup(docs: DataFrame, k: int = 20, with_text: bool = False, hash_of: Callable[[bytes, int], int] = word_hash) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; kept too if with_text."""
    keyed, seed = keyed_texts(docs), 0
    packed = packed_texts(keyed)
    while True:
        out = written(_result(packed, pieces(keyed, packed, k, seed, hash_of), with_text))
        if out.where("not verified").isEmpty():
            break
        seed += 1  # equal hashes of other words: all again with other hashes
    return out.select(from_doc_key("doc").alias("doc_id"), *[c for c in out.columns if c not in ("doc", "verified")])
