"""The near-dedup stage: five words, similarity 0.8, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from logquarry.llm import common, neardup
from tests.conftest import SMALL
from tests.llm.test_simhash import brute_components


def brute_kept(pairs):
    """The ids that stay: the smallest of each group linked by a similarity of 0.8 of five-word sets."""
    sets, holders = [], defaultdict(list)
    for n, (_, t) in enumerate(pairs):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
        for s in sets[-1]:
            holders[s].append(n)
    near = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    near = {(a, b) for a, b in near if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    group = brute_components(range(len(pairs)), lambda a, b: (b, a) in near)
    lowest = {}
    for n, (d, _) in enumerate(pairs):
        if d is not None:
            lowest[group[n]] = min(d, lowest.get(group[n], d))
    return set(lowest.values()), near


def edited_words(text, n, seed):
    w = text.split()
    for j in np.random.default_rng(seed).choice(len(w), n, replace=False):
        w[j] = f"edit{seed}x{j}"
    return " ".join(w)


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_stage_against_brute_force(spark, docs, prose, odd, monkeypatch, block):
    """Also with every group above a few texts dealt over pairs of blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    pairs = list(odd)
    for b in range(6):  # copies around the threshold: 2 to 8 words edited
        base = prose(b, 300)
        pairs += [(1000 * (b + 1), base)] + [(1000 * (b + 1) + i, edited_words(base, 2 + i % 7, 100 * b + i)) for i in range(1, 20)]
    kept, near = brute_kept(pairs)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(pairs), SMALL).where("doc_id is not null").select("doc_id").distinct().collect())
    assert got == sorted(kept) and len(near) > 100


def test_stage_on_the_small_table(spark):
    frame = common.documents(spark, SMALL)
    pairs = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, SMALL).collect()}
    assert got == brute_kept(pairs)[0]


def test_one_row_of_each_group_stays(spark, clash, prose):
    """Repeated rows, rows without an id and ids of several texts; extra columns stay."""
    text, other = prose(1, 80), prose(2, 80)
    pairs = [(3, text), (3, text), (None, text), (None, text), (None, other), (None, other), (4, None), (5, ""), (6, prose(3, 80)), (6, prose(4, 80)), (2, edited_words(prose(3, 80), 1, 1))]
    out = neardup.keep_first(clash(pairs))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted([(3, text), (-1, other), (4, ""), (6, prose(4, 80)), (2, edited_words(prose(3, 80), 1, 1))])
    assert "fp" in out.columns and not [c for c in out.columns if c.startswith("__")]
    assert neardup.keep_first(clash([]).limit(0)).count() == 0


def test_recall_of_candidates():
    """Pairs of similarity 0.8: within the radius of 128 bits, and in a bucket in common."""
    rng = np.random.default_rng(5)
    missed = 0
    for n in (20, 50, 200, 1000):
        for _ in range(100):
            union = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            common_part, rest = union[: n * 4 // 5], union[n * 4 // 5 :]
            a, b = (np.sort(np.concatenate([common_part, part])) for part in (rest[::2], rest[1::2]))
            x, y = (np.array(neardup.wide_fingerprint(s), np.int64).view(np.uint64) for s in (a, b))
            bits = int(np.bitwise_count(x ^ y).sum())
            missed += bits > neardup.RADIUS or not set(neardup.band_keys(a)) & set(neardup.band_keys(b))
    assert missed == 0


def test_forest_of_sets_equals_all_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
        sets += [np.unique(np.where(rng.random(60) < rng.random() / 6, rng.integers(0, 1 << 40, 60, dtype=np.uint64), base)) for _ in range(9)]

    def linked(i, j):
        common_part = len(np.intersect1d(sets[i], sets[j]))
        return common_part * 5 >= 4 * (len(sets[i]) + len(sets[j]) - common_part)

    want = brute_components(list(range(len(sets))), linked)
    assert neardup.similar_forest(sets).tolist() == [want[i] for i in range(len(sets))]
    assert 8 < len(set(want.values())) < 72
