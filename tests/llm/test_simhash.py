import re

import numpy as np
import pytest
import xxhash

from logquarry.llm import common, simhash


def brute_fingerprint(text, k=4):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "  ", "One", "a B c", "a b c d", "a b c d e f g", "x y z É é w", "rep " * 50, "tab\tnl\nvt\x0bff\x0ccr\rend"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 4, 7, 8, 15])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    values[100:] = values[:100]
    for i in range(100, 200):  # flip i - 100 bits, at most 20
        for b in rng.choice(64, (i - 100) % 21, replace=False):
            values[i] ^= np.uint64(1) << np.uint64(b)
    diff = values[:100] ^ values[100:]
    at, lanes = simhash.near_lanes(simhash.planes_of(diff), radius)
    i, j = simhash._pairs(at, lanes)
    found = {int(a * 64 + b) for a, b in zip(i, j, strict=True) if a * 64 + b < 100}
    assert found == {k for k in range(100) if int(diff[k]).bit_count() <= radius}


@pytest.mark.parametrize("sizes", [(1, 2, 3, 5, 70), (63, 64, 65), (300,), (2,) * 40])
def test_forest_equals_all_pairs(sizes):
    rng = np.random.default_rng(sum(sizes))
    group, values = [], []
    for g, n in enumerate(sizes):
        centres = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
        for _ in range(n):
            v = centres[rng.integers(3)]
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= np.uint64(1) << np.uint64(b)
            group.append(g)
            values.append(v)
    group, values = np.array(group), np.array(values, np.uint64)
    label = simhash.near_forest(group, values, 4)
    want = brute_components(list(range(len(values))), lambda a, b: group[a] == group[b] and int(values[a] ^ values[b]).bit_count() <= 4)
    assert label.tolist() == [want[i] for i in range(len(values))]


@pytest.mark.parametrize(("n", "pairs"), [(2081, 1 << 18), (2081, 500), (8192, 1 << 18)])
def test_dense_bucket_in_bounded_memory(monkeypatch, n, pairs):
    """Mutually near values in one bucket: the centre, its neighbours at one and at two bits, and at more."""
    import tracemalloc

    monkeypatch.setattr(simhash, "PAIRS", pairs)
    ball = [0] + [1 << b for b in range(64)] + [1 << b | 1 << c for b in range(64) for c in range(b)]
    ball += [1 << b | 1 << c | 1 << 63 | 1 << 62 for b in range(60) for c in range(b)] + [1 << b | 1 << c | 1 << d for b in range(60) for c in range(b) for d in range(c)]
    far = (np.arange(20, dtype=np.uint64) << np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5555555555555555)
    values = np.random.default_rng(n).permutation(np.concatenate([np.array(ball[: n - 20], np.uint64), far]))
    tracemalloc.start()
    label = simhash.near_forest(np.zeros(n, np.int64), values, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = np.bitwise_count(values[:, None] ^ values[None, ::]) <= 4 if n < 4096 else None
    assert peak < 64 << 20, peak
    if near is not None:
        left, right = np.nonzero(near)
        assert label.tolist() == common.min_labels(n, left, right).tolist()
    assert len(np.unique(label[np.isin(values, far, invert=True)])) == 1


def test_bucket_of_unlinked_rows_and_wide_values():
    """No pivot has a group, values have two words, and the radius is over 15."""
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    values[200:] = values[:100]
    for i in range(200, 300):
        for b in rng.choice(128, int(rng.integers(10, 40)), replace=False):
            values[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    apart = np.bitwise_count(values[:, None] ^ values[None]).sum(2)
    left, right = np.nonzero(apart <= 24)
    want = common.min_labels(300, left, right).tolist()
    assert simhash.near_block(values, 24).tolist() == want and 200 < len(set(want)) < 300


def test_bands_follow_the_count():
    assert [simhash.bands_to_agree(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**11)] == [2, 2, 2, 3, 4]


@pytest.mark.parametrize(("block", "agree"), [(4096, 2), (8, 2), (4096, 3), (8, 4)])
def test_links_find_every_class(spark, monkeypatch, block, agree):
    """Also with every bucket above a few rows dealt over pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    values = set()
    for _ in range(12):
        v = int(rng.integers(0, 1 << 62))
        for _ in range(30):  # a chain: each link at most four bits, the ends far apart
            values.add(v)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                v ^= 1 << int(b)
    values |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    fps = sorted(np.array(sorted(values), np.uint64).view(np.int64).tolist())
    want = brute_components(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    roots = common.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), agree=agree)).collect()
    got = dict.fromkeys(fps) | {r["node"]: r["root"] for r in roots}
    assert {f: got[f] if got[f] is not None else f for f in fps} == want


def test_large_bucket_around_a_hub_goes_out_in_proportion(spark, monkeypatch):
    """Near copies of one text: what is near the hub is one row a key, linked; nothing is dealt over pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    ball = [0] + [1 << b for b in range(64)] + [1 << b | 1 << c for b in range(64) for c in range(b)]
    fps = [f - (1 << 64 if f >> 63 else 0) for f in ball]
    def bucket(values):
        return spark.createDataFrame([(0, f, f) for f in values], "key long, node long, fp long")

    rows = bucket(fps)
    large = rows.groupBy("key").count().withColumnRenamed("count", "n")
    pieces, hubs = simhash._dealt(rows, large, 4)
    assert pieces.count() == 0 and hubs.count() == len(fps) - 1
    both = rows.unionByName(bucket([f ^ 0x3FF0000000000000 for f in fps[:40]]))
    pieces, hubs = simhash._dealt(both, both.groupBy("key").count().withColumnRenamed("count", "n"), 4)
    assert pieces.count() <= 5 * len(fps) + 40 * (len(fps) // 16 + 5)
    roots = common.components(simhash.links(both.select("fp").distinct(), 4, 2)).collect()
    assert len({r["root"] for r in roots}) == 2 and len(roots) == both.distinct().count()


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components_in_one_task_or_many(spark, monkeypatch, most):
    monkeypatch.setattr(common, "IN_ONE_TASK", most)
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, e)) for e in rng.integers(-50, 50, (60, 2))]
    want = brute_components(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in edges or (b, a) in edges)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: r for n, r in want.items() if list(want.values()).count(r) > 1}


def test_near_duplicates_against_brute_force(docs, prose, odd):
    pairs = list(odd) + [(100 + i, prose(i, 60)) for i in range(12)]
    pairs += [(200 + i, prose(i, 60).replace("w1", "W1")) for i in range(6)] + [(300 + i, prose(99, 400) + f" tail{i}") for i in range(10)]
    got = {(r["doc_id"], r["fp"] & (2**64 - 1)): r["component_id"] for r in simhash.near_duplicates(docs(pairs)).collect()}
    fp = [(d, brute_fingerprint(t)) for d, t in pairs]
    assert set(got) == set(fp)
    nodes = sorted({f for _, f in fp})
    root = brute_components(nodes, lambda a, b: (a ^ b).bit_count() <= 4)
    for d, f in fp:
        ids = [x for x, g in fp if root[g] == root[f] and x is not None]
        assert got[d, f] == (min(ids) if ids else None)


def test_row_count_and_empty(docs, odd):
    assert simhash.near_duplicates(docs(list(odd))).count() == len(odd)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_keep_first(clash, prose):
    pairs = [(1, prose(1, 80)), (2, prose(1, 80)), (3, prose(2, 80)), (None, prose(3, 80)), (4, None), (5, "")]
    out = simhash.keep_first(clash(pairs))
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 3, 4]
    assert "fp" in out.columns


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7777, 7777)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0
