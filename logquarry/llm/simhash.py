"""SimHash near-duplicates with bit-sliced comparison.

fingerprints(): XXH64 of every word shingle, majority per bit (Python over Arrow batches).
links(): distinct fingerprints meet where two of six bit bands agree (at most four differing bits leave
two bands untouched; three of seven or four of eight bands for corpora whose buckets would grow too full);
inside such a bucket the bit planes are stored vertically, the distances of 64 fingerprints at a time are kept in
carry-save counters, and blocks in which every lane has passed the radius are abandoned. Of buckets above
2 * BLOCK rows, what is near the bucket's hub is linked with it first, and the rest dealt over pairs of blocks, so
no task holds a whole large bucket; each task returns a spanning
forest of the links it found, never all pairs, and lists at most PAIRS of them at once.

Nulls: a null text has no words (fingerprint zero); a null doc_id is kept, and ignored as a smallest id
unless the group has no other. Repeated rows and equal texts share a fingerprint and so a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import components, min_labels, text_bytes, written

#: Rows of one bucket that one task compares with one another (twice that for a pair of blocks).
BLOCK = 4096
#: Fingerprints a bucket should hold on average at most; decides how many bands must agree.
FILL = 64
#: Lanes compared at once, and words of 64 lanes by queries; both bound the memory of the kernel.
LANES, WORDS = 1 << 18, 1 << 16
#: Pairs listed at once, however many are near.
PAIRS = 1 << 18
#: Pivots without a large group around them, after which a bucket is compared row by row.
PIVOTS = 4


def fingerprint(text: bytes, shingle: int = 4, bits: int = 64) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    counts = np.zeros(bits, np.int64)
    for i in range(0, n, 8192):
        part = np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8), bitorder="little")
        counts += part.reshape(-1, bits).sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of whole texts; other columns of docs are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes, (bits, words): bit b of 64 consecutive values is one 64-bit word of plane b. values: (rows,) or (rows, words)."""
    values = values.reshape(len(values), -1)
    padded = np.concatenate([values, np.zeros((-len(values) % 64, values.shape[1]), np.uint64)]).astype("<u8")
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def flips_of(values: np.ndarray) -> np.ndarray:
    """(bits, rows): each bit of each value, spread over a word of 64 lanes."""
    bits = np.unpackbits(values.reshape(len(values), -1).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return np.where(np.ascontiguousarray(bits.T), ~np.uint64(0), np.uint64(0))


def near_lanes(planes: np.ndarray, radius: int, words: np.ndarray | None = None, flips: np.ndarray | None = None, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(position, 64 lanes as bits) for each compared word that still has a lane within the radius.

    Without words, the planes are those of differences. Else position i compares the plane words words[i]
    with query query[i], whose bit b is spread over flips[b]. Carry-save adders take four planes at a time
    into as many counters (ones, twos, fours, ...) as the radius has bits; one more plane gathers overflow.
    """
    assert 0 <= radius < len(planes)
    n = planes.shape[1] if words is None else len(words)
    at = np.arange(n)
    counters = [np.zeros(n, np.uint64) for _ in range(max(2, radius.bit_length()))]
    over = np.zeros(n, np.uint64)
    full = ~np.uint64(0)

    def plane(b: int) -> np.ndarray:
        return planes[b][at] if words is None else planes[b][words[at]] ^ flips[b][query[at]]

    def add(a, b, c):
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    def passed() -> np.ndarray:
        """Lanes whose counter is over the radius."""
        above, equal = over.copy(), ~over
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return above

    for b in range(0, len(planes), 4):
        counters[0], t1 = add(counters[0], plane(b), plane(b + 1))
        counters[0], t2 = add(counters[0], plane(b + 2), plane(b + 3))
        counters[1], carry = add(counters[1], t1, t2)
        for k in range(2, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 4 and b > radius:
            keep = passed() != full
            if not keep.all():
                at = at[keep]
                counters, over = [x[keep] for x in counters], over[keep]
    return at, ~passed()


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lane) of every bit set."""
    return np.nonzero(np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def _pairs(at: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, lane = _lanes(lanes)
    return at[row], lane


def _pair_parts(at: np.ndarray, lanes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, lane) of every bit set, at most about PAIRS at once."""
    ends = np.cumsum(np.bitwise_count(lanes).astype(np.int64))
    start = 0
    while start < len(at):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        yield _pairs(at[start:stop], lanes[start:stop])
        start = stop


def near_queries(planes: np.ndarray, asked: np.ndarray, radius: int, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, word, 64 lanes as bits) of the given words against each of the asked values."""
    step = max(1, WORDS // max(len(words), 1))
    for q in range(0, len(asked), step):
        flips = flips_of(asked[q : q + step])
        word, query = np.tile(words, flips.shape[1]), np.repeat(np.arange(flips.shape[1]), len(words))
        at, lanes = near_lanes(planes, radius, word, flips, query)
        yield q + query[at], word[at], lanes


def reach(values: np.ndarray, radius: int, start: int = 0) -> np.ndarray:
    """Rows reachable from one row over links, itself included.

    Lanes that a query reaches are or-ed into one mask, so no pair is listed, and a lane that is reached is not compared again.
    """
    planes = planes_of(values)
    left = np.full(planes.shape[1], ~np.uint64(0))
    if len(values) % 64:
        left[-1] = (np.uint64(1) << np.uint64(len(values) % 64)) - np.uint64(1)
    left[start // 64] &= ~(np.uint64(1) << np.uint64(start % 64))
    found, frontier = [np.array([start])], np.array([start])
    while len(frontier) and left.any():
        live = np.flatnonzero(left)
        step = max(1, WORDS // len(live))
        asked, frontier = frontier[:step], frontier[step:]
        hit = np.zeros_like(left)
        for _, word, lanes in near_queries(planes, values[asked], radius, live):
            np.bitwise_or.at(hit, word, lanes)
        hit &= left
        left &= ~hit
        word, lane = _lanes(hit)
        found.append(word * 64 + lane)
        frontier = np.concatenate([frontier, found[-1]])
    return np.sort(np.concatenate(found))


def near_block(values: np.ndarray, radius: int) -> np.ndarray:
    """The number of the first row that each row is linked with, directly or over others."""
    label, todo, misses = np.arange(len(values)), np.arange(len(values)), 0
    while len(todo) > 64 and misses < PIVOTS:  # whole groups around a pivot
        found = reach(values[todo], radius)
        label[todo[found]] = todo[found[0]]
        misses += len(found) < 64
        todo = np.delete(todo, found)
    if len(todo) > 1:  # what is left: pairs, listed in bounded parts
        rest = values[todo]
        planes, own = planes_of(rest), np.arange(len(rest))
        for low in range(0, planes.shape[1], 16):  # earlier words hold pairs that earlier queries have compared
            asked = rest[low * 64 : (low + 16) * 64]
            for query, word, lanes in near_queries(planes, asked, radius, np.arange(low, planes.shape[1])):
                for k, lane in _pair_parts(np.arange(len(query)), lanes):
                    i, j = low * 64 + query[k], word[k] * 64 + lane
                    ok = (j < len(rest)) & (i < j)
                    own = min_labels(len(rest), i[ok], j[ok], own)
        label[todo] = todo[own]
    return label


def near_forest(group: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group: the number of the first row that each row is linked with inside its group."""
    n = len(values)
    label = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, n))
    small = np.repeat(size < 64, size)
    for d in range(1, int(size[size < 64].max(initial=1))):  # differences of rows d apart, of all small groups at once
        left = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        for i in range(0, len(left), LANES):
            part = left[i : i + LANES]
            for at, lane in _pair_parts(*near_lanes(planes_of(values[part] ^ values[part + d]), radius)):
                found = at * 64 + lane
                found = part[found[found < len(part)]]
                label = min_labels(n, found, found + d, label)
    for a, m in zip(first[size >= 64], size[size >= 64], strict=True):
        label[a : a + m] = a + near_block(values[a : a + m], radius)
    return label


def _bands(bits: int = 64, bands: int = 6) -> list[tuple[int, int]]:
    edge = [round(bits * i / bands) for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def bands_to_agree(count: int, radius: int) -> int:
    """The fewest bands (2 to 4) whose common bits spread so many fingerprints thinly enough."""
    return next((a for a in (2, 3) if count >> (64 * a // (radius + a)) < FILL), 4)


def links(fps: DataFrame, radius: int = 4, agree: int | None = None) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints; their components are those of all pairs within the radius.

    fps: one column fp, distinct. There are radius + agree bands, so that any pair within the radius agrees
    in some `agree` of them: every choice is exact, they differ in the number of keys and the size of the buckets.
    """
    agree = agree or bands_to_agree(fps.count(), radius)
    bands = _bands(bands=radius + agree)

    def key(number: int, chosen: tuple[int, ...]):
        out, shift = F.lit(number << 48), 0
        for k in chosen:
            start, width = bands[k]
            bits = F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << width) - 1))
            out, shift = out.bitwiseOR(F.shiftleft(bits, shift)), shift + width
        return out

    keys = [key(n, chosen) for n, chosen in enumerate(combinations(range(len(bands)), agree))]
    return bucket_links(fps.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), "fp"), radius)


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (src, dst) of a spanning forest of the pairs of one bucket within the radius.

    rows: key, node, then the words of the node's fingerprint; a node at most once a key.
    """
    words = rows.columns[2:]
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK))
    hubs = None
    if not large.isEmpty():
        rows, hubs = _dealt(rows, large, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(2 + len(words))]

        def forest(key, node, *value):
            first = np.concatenate(([True], key[1:] != key[:-1]))
            alone = first & np.concatenate((first[1:], [True]))
            key, node, value = key[~alone], node[~alone], np.stack(value, axis=1).view(np.uint64)[~alone]
            if not len(key):
                return
            label = near_forest(key, value, radius)
            linked = label != np.arange(len(label))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["src", "dst"])

        for b in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True)]
            if len(held[0]) >= 1 << 16:
                end = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
                yield from forest(*[h[:end] for h in held])
                held = [h[end:] for h in held]
        if len(held[0]):
            yield from forest(*held)

    ship_package(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "node")
    found = dealt.mapInArrow(run, "src long, dst long")
    return found if hubs is None else found.unionByName(hubs)


def piece_columns(own_near, far, near, spread) -> tuple:
    """(own block, other blocks) of a row of a dealt group with far and near blocks; a row without other blocks needs no comparison.

    Blocks 0 to far - 1 hold what is not near the group's hub. Near rows meet all far blocks, far rows all blocks, their own
    only where it is the one block there is.
    """
    own = F.when(own_near, far + F.pmod(spread, F.greatest(near, F.lit(1))).cast("int")).otherwise(F.pmod(spread, F.greatest(far, F.lit(1))).cast("int"))
    count = F.when(own_near, far).otherwise(far + near)
    every = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return own, F.filter(every, lambda other: (other != own) | ((far == 1) & (near == 0)))


def middles(rows: DataFrame, by: str, words: list[str]) -> DataFrame:
    """(by, middle_<word>...): the majority of each bit of a group's fingerprints."""
    bits = [F.sum(F.shiftrightunsigned(w, b).bitwiseAND(F.lit(1))).alias(f"{w}_{b}") for w in words for b in range(64)]

    def majority(word: str):
        out = F.lit(0).cast("long")
        for b in range(64):
            out = out.bitwiseOR(F.when(F.col(f"{word}_{b}") * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return written(rows.groupBy(by).agg(F.count("*").alias("n"), *bits).select(by, *[majority(w).alias(f"middle_{w}") for w in words]))


def apart_from(words: list[str]):
    """Makes the distance of a row's fingerprint from the one in <prefix>_<word>."""
    return lambda prefix: sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{prefix}_{w}"))) for w in words), F.lit(0))


def _dealt(rows: DataFrame, large: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(rows with each large bucket in bounded pieces, links (src, dst) to the buckets' hubs).

    A large bucket's hub is its member next to the majority of its bits. Members near the hub are linked with it and
    need no comparison with each other; all others are dealt over blocks, and each pair of blocks is one piece
    unless both hold members near the hub: a group of near copies of one text goes out in proportion to its size.
    """
    columns, words = rows.columns, rows.columns[2:]
    busy = rows.join(large.select("key"), "key")
    middle, apart = middles(busy, "key", words), apart_from(words)
    nearest = F.min(F.struct(apart("middle").alias("d"), F.col("node").alias("hub"), *[F.col(w).alias(f"hub_{w}") for w in words]))
    hubs = written(busy.join(middle, "key").groupBy("key").agg(nearest.alias("h")).select("key", "h.hub", *[f"h.hub_{w}" for w in words]))
    sided = busy.join(hubs, "key").withColumn("near", apart("hub") <= radius)
    counts = sided.groupBy("key").agg(F.sum(F.col("near").cast("long")).alias("n_near"), F.count("*").alias("n_all"))
    blocks = written(counts.select("key", F.ceil(F.col("n_near") / BLOCK).cast("int").alias("near_blocks"), F.ceil((F.col("n_all") - F.col("n_near")) / BLOCK).cast("int").alias("far_blocks")))
    own, others = piece_columns(F.col("near"), F.col("far_blocks"), F.col("near_blocks"), F.xxhash64("node"))
    placed = sided.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(others))
    pieces = placed.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *columns[1:])
    to_hub = sided.where("near AND node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst")).distinct()
    return rows.join(large.select("key"), "key", "left_anti").select(*columns).unionByName(pieces), to_hub


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id): component_id the smallest doc_id reachable over links."""
    marked = written(fingerprints(docs, shingle))
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = written(rooted.join(lowest, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id (a row without an id only where no other has one)."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    rows = written(docs.withColumn("__fp", marked(text_bytes())).withColumn("__row", F.monotonically_increasing_id()))
    classes = rows.groupBy(F.col("__fp").alias("fp")).agg(first_row().alias("first"))
    roots = components(links(written(classes.select("fp")), radius))
    return one_of_each(rows, classes, "fp", roots)


def first_row():
    """The row of the smallest id; rows without one come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("row")))


def one_of_each(rows: DataFrame, classes: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """Of each group the first row, without the helping columns. classes: (node, first); roots: (node, root) where they differ."""
    rooted = classes.join(roots.select(F.col("node").alias(node), "root"), node, "left").groupBy(F.coalesce("root", node).alias("root"))
    kept = rooted.agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    gone = written(rows.select("__row").join(kept, "__row", "left_anti"))  # fewer than those that stay
    return rows.join(gone, "__row", "left_anti").drop(*[c for c in rows.columns if c.startswith("__")])
