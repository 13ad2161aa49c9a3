"""Operator 2 at a stated similarity: SimHash near-duplicates whose links are confirmed exactly.

Texts are compared as sets of SHINGLE-word shingles (A-Z lower-cased, blanks as in `simhash`; a shorter text is one
shingle), each known by a 64-bit hash. Equal word sequences are one class (64-bit hash). Every class has a SimHash
fingerprint of 128 bits; those of one bucket are compared by bit planes and carry-save counters, and the pairs within
RADIUS bits connect classes to candidate groups. No bits of a fingerprint are common to all texts of a similarity of
0.8, so the buckets are the classes that agree in one of BANDS bands of ROWS shingle minima: a pair of similarity s
shares none with a chance of (1 - s^ROWS)^BANDS, 3e-6 at 0.8, and at 0.8 two fingerprints differ by 19 bits of 128 on
average with a deviation of 4.

Inside a candidate group, which holds each text once, sets are compared exactly, from one row to all that it reaches;
only a similarity of at least SIMILAR links. Groups above 2 * BLOCK shingles are dealt over pairs of blocks: what is
similar to the group's hub is linked with it first, and blocks that are both similar to the hub do not meet.

Nulls: a null text has no words and equals an empty one; rows with a null doc_id are not named as a smallest id, and stay
only where no row of their group has an id. Of equal rows one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import components, min_labels, mix64, text_bytes, written
from .simhash import apart_from, bucket_links, first_row, middles, one_of_each, piece_columns

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 5
#: Bits of 128 in which the fingerprints of candidates differ at most.
RADIUS = 44
#: Shingles of one candidate group that one task compares with one another (twice that for a pair of blocks).
BLOCK = 1 << 17
#: Shingles hashed at once.
STEP = 1024

_seeds = np.random.default_rng(42)
_TIMES = _seeds.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _seeds.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the k-word shingles, ascending."""
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64(out * _FACTOR + word[j : j + n])
    return np.unique(out)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(half), STEP):
        part = half[i : i + STEP]
        for a in range(0, BANDS * ROWS, 8):
            np.minimum(low[a : a + 8], (_TIMES[a : a + 8, None] * part + _PLUS[a : a + 8, None]).min(1), out=low[a : a + 8])
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix64(key * _FACTOR + rows[:, j] + np.uint64(1))
    return key.view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits, each set where over half the shingles have it; as two signed numbers."""
    both = np.stack([hashes, mix64(hashes ^ _FACTOR)], axis=1).astype("<u8")
    counts = np.zeros(128, np.int64)
    for i in range(0, len(both), STEP):
        counts += np.unpackbits(both[i : i + STEP].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    one, two = np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8").tolist()
    return one, two


def sketches(docs: DataFrame) -> DataFrame:
    """All columns of docs, with __row (a number), __node (hash of the words), __size (distinct shingles), __keys, __one and __two."""
    def run(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh3_64_intdigest

        rows = []
        for t in texts:
            words = t.lower().split()
            found = shingles(words)
            node = np.uint64(xxh3_64_intdigest(b" ".join(words))).astype(np.int64)
            rows.append((node, len(found), band_keys(found), *wide_fingerprint(found)))
        return pd.DataFrame(rows, columns=["node", "size", "keys", "one", "two"])

    ship_package(docs.sparkSession)
    udf = F.pandas_udf(run, "node long, size long, keys array<long>, one long, two long").asNondeterministic()
    out = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__s", udf(text_bytes()))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__row", *[F.col(f"__s.{c}").alias(f"__{c}") for c in ("node", "size", "keys", "one", "two")])


def similar_forest(sets: list[np.ndarray]) -> np.ndarray:
    """The number of the first set that each is linked with, directly or over others.

    From one set all others are counted at once; sets that it reaches ask the ones left, so no pair is listed.
    """
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    codes, index = np.unique(np.concatenate(sets), return_inverse=True)
    index = index.reshape(-1)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    own = [index[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    left = np.arange(len(sets))  # not yet reached
    while len(left):
        first, left = left[0], left[1:]
        frontier = [first]
        flat, heads, room = np.empty(0, np.int64), np.empty(0, np.int64), -1
        while frontier and len(left):
            if room != len(left):  # the codes of the sets left, one after the other
                flat = np.concatenate([own[i] for i in left])
                heads = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
                room = len(left)
            asked = frontier.pop()
            mark = np.zeros(len(codes), np.int64)
            mark[own[asked]] = 1
            common = np.add.reduceat(mark[flat], heads)
            near = common * SIMILAR[1] >= SIMILAR[0] * (sizes[asked] + sizes[left] - common)
            if near.any():
                label[left[near]] = first
                frontier += left[near].tolist()
                left = left[~near]
    return label


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    return [shingles(t.lower().split()) for t in texts]


def verified(members: DataFrame) -> DataFrame:
    """Edges (src, dst) between similar members of one group. members: group, node, size, one, two, text; a node once."""
    sizes = members.groupBy("group").agg(F.sum("size").alias("shingles"), F.count("*").alias("n"))
    large = written(sizes.where((F.col("shingles") > 2 * BLOCK) & (F.col("n") > 2)).select("group"))
    rows, to_hub = members.select("group", "node", "text"), None
    if not large.isEmpty():
        pieces, to_hub = _dealt(members.join(large, "group"))
        rows = rows.join(large, "group", "left_anti").select("group", "node", "text").unionByName(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def linked():
            label = similar_forest(sets) if len(sets) > 1 else np.arange(len(sets))
            at = np.flatnonzero(label != np.arange(len(sets)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in at], pa.int64()), pa.array([nodes[i] for i in label[at]], pa.int64())], ["src", "dst"])

        for b in batches:
            for g, node, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    yield from linked()
                    group, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(shingles(text.lower().split()))
        yield from linked()

    ship_package(members.sparkSession)
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "group").sortWithinPartitions("group", "node").mapInArrow(run, "src long, dst long")
    return found if to_hub is None else found.unionByName(to_hub)


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces (group, node, text) of large groups, links (src, dst) to the groups' hubs)."""
    words = ["one", "two"]
    distance = apart_from(words)("middle")
    hubs = members.drop("text").join(middles(members, "group", words), "group").groupBy("group").agg(F.min(F.struct(distance.alias("d"), F.col("node").alias("hub"))).alias("h"))
    hubs = hubs.select("group", "h.hub").alias("h").join(members.alias("m"), F.expr("h.group = m.group AND h.hub = m.node"))
    hubs = written(hubs.select("h.group", "h.hub", F.col("m.text").alias("hub_text")))

    @F.pandas_udf("boolean")
    def near_hub(texts: pd.Series, hub_texts: pd.Series) -> pd.Series:
        known: dict[bytes, np.ndarray] = {}
        out = []
        for t, h in zip(texts, hub_texts, strict=True):
            if h not in known:
                known.clear()
                known[h] = _sets([h])[0]
            s = _sets([t])[0]
            common = len(np.intersect1d(s, known[h], assume_unique=True))
            out.append(common * SIMILAR[1] >= SIMILAR[0] * (len(s) + len(known[h]) - common))
        return pd.Series(out, dtype=bool)

    sided = written(members.join(hubs, "group").select("group", "node", "size", "text", "hub", near_hub("text", "hub_text").alias("near")))
    counts = sided.groupBy("group").agg(F.sum(F.when(F.col("near"), F.col("size"))).alias("near_size"), F.sum(F.when(~F.col("near"), F.col("size"))).alias("far_size"))
    blocks = written(counts.select("group", *[F.ceil(F.coalesce(f"{side}_size", F.lit(0)) / BLOCK).cast("int").alias(f"{side}_blocks") for side in ("near", "far")]))
    own, others = piece_columns(F.col("near"), F.col("far_blocks"), F.col("near_blocks"), F.xxhash64("node"))
    placed = sided.join(blocks, "group").withColumn("own", own).withColumn("other", F.explode(others))
    pieces = placed.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "text")
    return pieces, sided.where("near AND node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst"))


def groups(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes (node, first), roots (node, root) of those linked with a smaller node). marked: written sketches."""
    of_class = marked.groupBy(F.col("__node").alias("node")).agg(
        first_row().alias("first"), *[F.first(f"__{c}").alias(c) for c in ("size", "keys", "one", "two")]
    )
    classes = written(of_class)
    rows = classes.select(F.explode("keys").alias("key"), "node")
    shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    live = written(rows.join(shared, "key"))  # keys and nodes only: fingerprints follow for the nodes that are left
    known = classes.join(written(live.select("node").distinct()), "node", "left_semi").select("node", "one", "two")
    candidates = written(components(bucket_links(written(live.join(written(known), "node").select("key", "node", "one", "two")), RADIUS)))
    named = written(classes.select("node", "size", "one", "two", F.col("first.row").alias("__row")).join(candidates, "node"))  # few: texts need not be shuffled
    texts = marked.select("__row", text_bytes().alias("text"))
    members = written(named.join(texts, "__row").select(F.col("root").alias("group"), "node", "size", "one", "two", "text"))
    return classes.select("node", "first"), written(components(verified(members)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component_id): component_id the smallest doc_id reachable over links."""
    marked = written(sketches(docs))
    classes, roots = groups(marked)
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    ids = rooted.join(written(lowest), "root").select("node", "component_id")
    return marked.select("doc_id", F.col("__node").alias("node")).join(written(ids), "node").select("doc_id", "node", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id."""
    marked = written(sketches(docs))
    classes, roots = groups(marked)
    return one_of_each(marked, classes, "node", roots)
