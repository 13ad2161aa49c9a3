"""Substring dedup, line dedup, decontamination: against brute force on small fixtures."""

import hashlib

import numpy as np
import pytest

from logquarry.llm import decontam, linededup, substring


def brute_spans(pairs, k):
    """Sorted (doc_id, words, removed, hash of what is left) of all rows."""
    first, out = {}, {}
    for d, t in by_row(pairs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in first:
                gone[i : i + k] = [True] * k
            else:
                first[key] = 1
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, t] = (-1 if d is None else d, len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return sorted(out[p] for p in pairs)


def check_substring(docs, pairs, k=20, **more):
    rows = substring.dedup(docs(pairs), k, **more).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
    assert got == brute_spans(pairs, k)


def test_shared_passages(docs, prose):
    passage, long = prose(1, 60), prose(2, 500)
    pairs = [(1, passage), (2, prose(3, 30) + " " + passage + " " + prose(4, 30)), (3, long), (4, long), (5, prose(5, 100) + " " + long[300:900] + " " + prose(6, 50)), (6, passage + " " + passage), (7, "a b c"), (9, None), (8, "")]
    check_substring(docs, pairs)


def test_edited_copies_and_borders(docs, prose):
    base = prose(10, 300).split()
    pairs = []
    for i in range(12):
        w = list(base)
        for j in np.random.default_rng(i).choice(300, i, replace=False):
            w[j] = f"edit{i}_{j}"
        pairs.append((i, " ".join(w)))
    pairs += [(100 + n, " ".join(base[:n])) for n in (18, 19, 20, 21, 40)]
    check_substring(docs, pairs)


@pytest.mark.parametrize("text", ["x " * 200, "a b " * 100, "a b c d e f g " * 40, " ".join(f"p{i % 23}" for i in range(300))])
def test_texts_that_repeat_themselves(docs, text):
    check_substring(docs, [(1, text), (2, text[: len(text) // 2]), (3, "q " + text)])


@pytest.mark.parametrize("seed", range(4))
def test_random_small_alphabet(docs, seed):
    rng = np.random.default_rng(seed)
    pairs = [(i, " ".join(f"{x}" for x in rng.integers(0, 3, rng.integers(0, 120)))) for i in range(40)]
    check_substring(docs, pairs, k=8)


def test_substring_odd_rows(docs, odd, clash):
    rows = substring.dedup(clash(list(odd))).collect()
    assert len(rows) == len(odd)
    by = {r["doc_id"]: r for r in rows}
    assert (by[5]["n_words"], by[5]["n_removed"]) == (200_000, 199_999)
    assert by[1]["n_words"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert substring.dedup(docs([])).count() == 0


def test_repeated_rows_do_not_remove_each_other(docs, prose):
    t = prose(1, 50)
    assert [r["n_removed"] for r in substring.dedup(docs([(1, t), (1, t)])).collect()] == [0, 0]


def test_rows_that_share_an_id(docs, prose):
    """Repeated and null ids: unique text stays, also beside a copy of the same id."""
    a, z, y = prose(1, 30, 10**6), prose(2, 30, 10**6), prose(3, 45, 10**6)
    check_substring(docs, [(1, a), (7, a), (7, z), (7, z), (9, z + " " + a)])
    check_substring(docs, [(None, a), (None, z), (None, y), (5, y + " " + z)])
    rows = substring.dedup(docs([(None, a), (None, a + " end"), (None, y)])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 0, 30]


def test_equal_hashes_of_other_words(docs, prose):
    """Under the first seeds words collide: paths fail at their source, and the run is done again."""

    def weak(word, seed):
        return (sum(word) % 3 if seed == 0 else int.from_bytes(word[-1:]) if seed == 1 else hash_words(word)) * 0x9E3779B97F4A7C15 % 2**64

    def hash_words(word):
        return int.from_bytes(hashlib.sha256(word).digest()[:8])

    passage = prose(1, 60)
    pairs = [(1, prose(2, 50) + " " + passage), (2, prose(3, 60)), (3, passage + " " + prose(4, 50)), (4, passage)]
    check_substring(docs, pairs, hash_of=weak)


def test_paths_compact():
    """Windows that go on as their source does are one path; another source or distance is another."""
    start, n, doc, mark, src = (np.array(x) for x in ([0, 1, 2, 10, 5, 3, 20], [1, 1, 1, 4, 5, 1, 1], [1, 1, 1, 1, 1, 2, 1], [0] * 7, [4, 5, 6, 14, 9, 7, 90]))
    got = sorted(zip(*(x.tolist() for x in substring.compact(start, n, doc, mark, src)), strict=True))
    assert got == [(0, 3, 1, 0, 4), (3, 1, 2, 0, 7), (5, 9, 1, 0, 9), (20, 1, 1, 0, 90)]


# Lines


def by_row(pairs):
    """Documents in the operators' order: each (doc_id, text) once."""
    return sorted(set(pairs), key=lambda x: (x[0] is not None, x[0] or 0))


def own_chunks(text):
    """The chunks of a text, written out anew: lines after which the rolling hash of the last two says so end a chunk."""
    import xxhash

    lines, chunks, start = text.split("\n"), [], 0
    if len(lines) < 2:
        return [lines]
    h = [xxhash.xxh3_64_intdigest(x.encode()) for x in lines]
    for i in range(len(lines)):
        roll = (h[i] + (h[i - 1] * 0x9E3779B97F4A7C15 if i else 0)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            roll = (roll ^ roll >> shift) * factor % 2**64
        length = i + 1 - start
        if length >= 16 or (length >= 2 and (roll ^ roll >> 31) % 2 == 0) or i + 1 == len(lines):
            chunks.append(lines[start : i + 1])
            start = i + 1
    return chunks


def brute_lines(pairs):
    """doc_id -> text left: chunks of two and more lines stay at their first place only."""
    first, out = set(), {}
    for d, t in by_row(pairs):
        kept = []
        for chunk in own_chunks(t or ""):
            if len(chunk) >= 2 and tuple(chunk) in first:
                continue
            first.add(tuple(chunk))
            kept += chunk
        out[d] = None if t is None else "\n".join(kept)
    return out


def some_lines(seed, n):
    rng = np.random.default_rng(seed)
    return [f"line {x}" for x in rng.integers(0, 10**9, n)]


def test_line_dedup_against_brute_force(docs):
    block = some_lines(1, 40)
    pairs = [(1, "\n".join(block)), (2, "\n".join(some_lines(2, 5) + block + some_lines(3, 5))), (3, "\n".join(some_lines(4, 3) + block[7:30])), (4, "\n".join(block)), (5, "single"), (6, None), (7, ""), (8, "\n".join(["same"] * 60)), (9, "\n\n\n")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs(pairs)).collect()}
    assert got == brute_lines(pairs)
    assert len(got[2]) < len(pairs[1][1]) and got[4] == ""


def test_boundaries_survive_an_insertion():
    block = some_lines(5, 200)
    ends = {tuple(block[i] for i in range(a, a + n)) for a, n, _ in linededup.chunks("\n".join(block).encode())}
    shifted = some_lines(6, 3) + block
    moved = {tuple(shifted[i] for i in range(a, a + n)) for a, n, _ in linededup.chunks("\n".join(shifted).encode())}
    assert len(ends & moved) > 0.9 * len(ends)
    assert all(n <= linededup.MOST for _, n, _ in linededup.chunks(("z\n" * 500).encode()))


@pytest.mark.parametrize("by", [linededup.CHUNKS, linededup.PASSAGES])
def test_equal_hashes_of_other_bytes(docs, by):
    """All bodies collide: what differs stays, what is equal goes, also where the first of the hash is another."""

    def same_hash(body):
        return 7

    pairs = [(1, "a\nb"), (2, "c\nd"), (3, "c\nd"), (4, "e\nf"), (5, "a\nb"), (6, "c\nd")]
    for rows in (pairs, pairs[:4]):
        got = {r["doc_id"]: r["n_removed"] for r in linededup.dedup(docs(rows).repartition(6), by, same_hash).collect()}
        assert got == {d: {3: 2, 5: 2, 6: 2}.get(d, 0) for d, _ in rows}


@pytest.mark.parametrize("by", [linededup.CHUNKS, linededup.PASSAGES])
def test_lines_of_rows_that_share_an_id(docs, by):
    """Repeated and null ids: a text that repeats nothing loses nothing."""
    a, z, y = ("\n".join(some_lines(n, 30)) for n in (70, 71, 72))
    pairs = [(1, a), (7, a), (7, z), (7, z), (None, z.upper()), (None, y), (None, y + "\nend"), (8, z)]
    rows = sorted((r["doc_id"] or -1, r["n_lines"], r["n_removed"]) for r in linededup.dedup(docs(pairs), by).collect())
    first_y = [r for r in rows if r[0] == -1 and r[2] > 20]
    assert len(first_y) == 1 and first_y[0][1] in (30, 31)
    assert [r for r in rows if r not in first_y] == sorted([(1, 30, 0), (7, 30, 30), (7, 30, 0), (7, 30, 0), (8, 30, 30), (-1, 30, 0), (-1, 61 - first_y[0][1], 0)])


def test_line_dedup_odd_rows(docs, odd, clash):
    out = linededup.dedup(clash([p for p in odd]).drop("n_lines"))
    assert out.count() == len(odd)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[4] == "one" and texts[1] is None
    assert linededup.dedup(docs([])).count() == 0
    assert linededup.digest(docs([(1, "a\nb")])).columns == ["doc_id", "n_lines", "n_removed", "kept_sha256"]


def brute_passages(pairs):
    """doc_id -> text left: lines of any two consecutive lines seen before go, whatever chunks there are."""
    seen, out = set(), {}
    for d, t in by_row(pairs):
        lines, gone = (t or "").split("\n"), set()
        for i in range(len(lines) - 1):
            if (lines[i], lines[i + 1]) in seen:
                gone |= {i, i + 1}
            seen.add((lines[i], lines[i + 1]))
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_repeated_passages_go_whole(docs, seed):
    rng = np.random.default_rng(seed)
    blocks = [some_lines(100 + i, i + 2) for i in range(6)]  # 2 to 7 lines
    pairs = [(d, "\n".join(some_lines(1000 * seed + 10 * d, 3) + blocks[d % 6] + some_lines(1000 * seed + 10 * d + 1, 1 + d % 4) + [blocks[(d + 1) % 6][0]] + some_lines(1000 * seed + 10 * d + 2, 2))) for d in range(1, 25)]
    pairs += [(30, "\n".join(["same"] * 60)), (31, None), (32, ""), (33, "single"), (None, pairs[0][1])]
    pairs += [(40 + d, "\n".join(f"v{x}" for x in rng.integers(0, 6, 30))) for d in range(8)]
    out = linededup.dedup(docs(pairs), linededup.PASSAGES).collect()
    want = brute_passages(pairs)
    assert {r["doc_id"]: r["text"] for r in out} == want
    digests = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in linededup.digest(docs(pairs)).collect()}
    assert {d: x[2] for d, x in digests.items()} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in want.items()}
    assert all(digests[d][1] >= d % 6 + 2 for d in range(7, 25))


# Benchmark items


def distance(item, text):
    """Least edits of the item against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, a in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        sub = row[:-1] + (np.frombuffer(text, np.uint8) != a) if text else row[:-1]
        best = np.minimum(sub, row[1:] + 1)
        for j in range(len(text)):
            new[j + 1] = min(best[j], new[j] + 1)
        row = new
    return int(row.min())


def edited(text, n, seed):
    rng, out = np.random.default_rng(seed), bytearray(text)
    for _ in range(n):
        i, kind = int(rng.integers(len(out))), rng.integers(3)
        if kind == 0:
            out[i] = int(rng.integers(97, 123))
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, int(rng.integers(97, 123)))
    return bytes(out)


@pytest.mark.parametrize("seed", range(25))
def test_every_region_in_the_budget_is_found(seed):
    rng = np.random.default_rng(seed)

    def letters(n):
        return rng.integers(97, 105, n).astype(np.uint8).tobytes()

    items = [letters(rng.integers(40, 200)) for _ in range(6)]
    index = decontam.Index(list(range(6)), items, 0.1)
    i = seed % 6
    leak = edited(items[i], int(rng.integers(0, int(len(items[i]) * 0.13) + 1)), seed)
    text = letters(rng.integers(0, 80)) + leak + letters(rng.integers(0, 80))
    found = {r[0]: r for r in index.regions(text)}
    for j in range(6):
        d = distance(items[j], text)
        assert (j in found) == (d <= index.edits[j])
        if j in found:
            assert found[j][3] == d
            assert distance(items[j], text[found[j][1] : found[j][2]]) == d


def test_find_and_remove(spark, docs, prose, clash, odd):
    items = [(1, prose(1, 40)), (2, prose(2, 30)), (3, None), (4, ""), (5, "tiny"), (6, prose(1, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = [(10, prose(7, 100) + " " + items[0][1].upper() + "\n" + prose(8, 20)), (11, prose(9, 300)), (12, items[1][1].replace("w", "v", 1)), *odd]
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_leaks(clash(pairs), bench).collect()}
    assert found == {(10, 1): 0, (10, 6): 0, (12, 2): 1}
    kept = decontam.remove_leaks(clash(pairs), bench)
    assert kept.count() == len(pairs) - 2 and kept.columns == clash(pairs).columns
    assert decontam.remove_leaks(docs(pairs), bench.limit(0)).count() == len(pairs)
    assert decontam.find_leaks(docs([]), bench).count() == 0


def test_items_in_blocks_give_the_same(spark, docs, prose, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 30)) for i in range(6)], "item_id long, text string")
    frame = docs([(i, prose(50 + i, 50) + " " + prose(i, 30)) for i in range(6)])
    whole = sorted(map(str, decontam.find_leaks(frame, bench).collect()))
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (200,))
    assert sorted(map(str, decontam.find_leaks(frame, bench).collect())) == whole and len(whole) == 6
    odd = frame.unionByName(frame.limit(2)).unionByName(docs([(None, None), (None, prose(3, 30)), (None, "")]))
    assert decontam.remove_leaks(odd, bench).count() == 2 and decontam.find_leaks(odd, bench).count() == 9


@pytest.mark.parametrize("error", [0.08, 0.2])
def test_items_without_a_bound(error):
    """13 to 15 bytes with one edit, higher rates, and items of under eight bytes as whole words."""
    rng = np.random.default_rng(int(error * 100))
    checked = 0
    for n in (13, 14, 15, 40):
        for seed in range(12):
            item = rng.integers(97, 105, n).astype(np.uint8).tobytes()
            index = decontam.Index([5], [item], error)
            text = rng.integers(97, 105, 30).astype(np.uint8).tobytes() + edited(item, seed % (int(n * error) + 2), seed) + rng.integers(97, 105, 30).astype(np.uint8).tobytes()
            d, found = distance(item, text), index.regions(text)
            assert bool(found) == (d <= int(n * error)), (item, text)
            assert not found or min(r[3] for r in found) == d
            checked += bool(found)
    assert checked > 20
    short = decontam.Index([1, 2, 3], [b"abc", b"a b", b"\xc3\xa9"], error)
    assert short.regions(b"xabc abcx abc") == [(1, 10, 13, 0)] and short.regions(b"a b abc") == [(1, 4, 7, 0), (2, 0, 3, 0)]
    assert short.regions(b"abc") == [(1, 0, 3, 0)] and short.regions("x é".encode()) == [(3, 2, 4, 0)] and short.regions(b"") == []


def test_repetitive_long_text_in_bounded_memory(monkeypatch):
    import tracemalloc

    index = decontam.Index([1, 2], [(b"ab " * 100).strip(), b"nothing like this is in the text at all"], 0.08)
    tracemalloc.start()
    found = index.regions(b"ab " * 40_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak
    assert [r[0] for r in found] == [1] * len(found) and len(found) > 300 and all(r[3] == 0 for r in found)
    text = b"x y z " * 3000 + index.items[1].replace(b"like", b"lik") + b" x y z" * 3000
    whole = index.regions(text)
    monkeypatch.setattr(decontam, "SLICE", 64)
    monkeypatch.setattr(decontam, "PAIRS", 50)
    assert index.regions(text) == whole == [(2, 18000, 18038, 1)]


def test_short_items_in_frames(spark, docs):
    bench = spark.createDataFrame([(1, "abc"), (2, " "), (3, None)], "item_id long, text string")
    assert [tuple(r) for r in decontam.find_leaks(docs([(1, "abc"), (2, "abcd"), (None, None)]), bench).collect()] == [(1, 1, 0, 3, 0)]


def test_line_and_substring_queries_match_sql(spark, duck):
    from logquarry.llm import queries
    from tests.conftest import SMALL

    for name, sql in queries.oracle_sql().items():
        if name in ("op4_sharding", "op5_linededup"):
            want = duck.sql(sql)
            got = queries.queries()[name](spark, SMALL).select(*want.columns).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())), name


def test_substring_query_matches_sql(spark, duck):
    from logquarry.llm import queries
    from tests.conftest import SMALL

    want = duck.sql(queries.OP3_SQL)
    got = queries.op3_substring(spark, SMALL).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
