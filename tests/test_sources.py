import bz2
import gzip
import os
import shutil

import pytest

from logquarry.sources import files, ledger


def write(path, texts, opener=open, mode="wb"):
    with opener(path, mode) as f:
        f.write("".join(t + "\n" for t in texts).encode())
    return str(path)


class Runner:
    """Runs the planner over a folder and keeps its ledger, as the command does."""

    def __init__(self):
        self.ledger = []

    def run(self, *paths):
        plans = ledger.plan(sorted(map(str, paths)), self.ledger)
        done, new = {}, 0
        for p in plans:
            if p.read:
                for at, line in files.tail_lines(p.seen.path, p.start, None):
                    done[p.seen.path] = at + len(line) + 1
                    new += 1
        self.ledger = ledger.update(self.ledger, plans, done)
        return new


@pytest.fixture
def runner():
    return Runner()


def text(a, b, tag="line"):
    return [f"{tag} {i} " + "x" * 90 for i in range(a, b)]


def test_append_and_unchanged(tmp_path, runner):
    p = write(tmp_path / "a.log", text(0, 200))
    assert runner.run(p) == 200
    assert runner.run(p) == 0
    write(p, text(200, 203), mode="ab")
    assert runner.run(p) == 3


def test_small_file_grows_below_the_head(tmp_path, runner):
    p = write(tmp_path / "a.log", text(0, 3))
    assert runner.run(p) == 3
    write(p, text(3, 4), mode="ab")
    assert runner.run(p) == 1


def test_shrunk_file_starts_over(tmp_path, runner):
    p = write(tmp_path / "a.log", text(0, 200))
    runner.run(p)
    write(p, text(500, 510))
    assert runner.run(p) == 10
    assert any(e.retired for e in runner.ledger)


def test_rename_keeps_history(tmp_path, runner):
    p = write(tmp_path / "a.log", text(0, 200))
    runner.run(p)
    os.rename(p, tmp_path / "a.log.1")
    assert runner.run(tmp_path / "a.log.1") == 0


def test_rotation_is_independent_of_order(tmp_path, runner):
    p = write(tmp_path / "access.log", text(0, 200))
    runner.run(p)
    write(p, text(200, 201), mode="ab")
    os.rename(p, tmp_path / "access.log.1")
    write(p, [])
    assert runner.run(p, tmp_path / "access.log.1") == 1
    assert runner.run(p, tmp_path / "access.log.1") == 0


def test_copy_truncate(tmp_path, runner):
    p = write(tmp_path / "a.log", text(0, 120))
    runner.run(p)
    write(p, text(120, 121), mode="ab")
    shutil.copy(p, tmp_path / "a.log.1")
    with open(p, "wb") as f:
        f.write(("new line " + "y" * 90 + "\n").encode())
    assert runner.run(p, tmp_path / "a.log.1") == 2
    assert runner.run(p, tmp_path / "a.log.1") == 0


@pytest.mark.parametrize(("opener", "suffix"), [(gzip.open, ".gz"), (bz2.open, ".bz2")])
def test_compressed_members(tmp_path, runner, opener, suffix):
    p = write(tmp_path / f"a.log{suffix}", text(0, 500), opener)
    assert runner.run(p) == 500
    assert runner.run(p) == 0
    write(p, text(500, 501), opener, "ab")
    assert runner.run(p) == 1


def test_compressed_copy_of_a_done_file(tmp_path, runner):
    p = write(tmp_path / "a.log", text(0, 300))
    runner.run(p)
    q = write(tmp_path / "a.log.1.gz", text(0, 300), gzip.open)
    assert runner.run(q) == 0


def test_compressed_new_inode(tmp_path, runner):
    p = write(tmp_path / "a.log.gz", text(0, 1000), gzip.open)
    runner.run(p)
    os.rename(p, tmp_path / "gone")
    write(p, text(0, 1200, "other"), gzip.open)
    assert runner.run(p) == 1200
    os.rename(p, tmp_path / "gone2")
    write(p, text(0, 1210, "other"), gzip.open)
    assert runner.run(p) == 10


def test_unterminated_line_waits(tmp_path, runner):
    p = str(tmp_path / "a.log")
    with open(p, "wb") as f:
        f.write(b"one\ntw")
    assert runner.run(p) == 1
    with open(p, "ab") as f:
        f.write(b"o\n")
    assert runner.run(p) == 1


def test_globs_and_ranges(tmp_path, spark):
    a, b = write(tmp_path / "a.log", text(0, 50)), write(tmp_path / "b.log.gz", text(50, 60), gzip.open)
    assert files.expand_globs(f"{tmp_path}/*.log, {tmp_path}/a*,{tmp_path}/b.log.gz, {tmp_path}/none*") == [a, b]
    assert files.expand_globs(" , ") == []
    assert files.read_lines(spark, [a, b]).count() == 60
    assert files.read_lines(spark, []).count() == 0
    ranges = files.line_ranges(a, 4)
    got = files.read_ranges(spark, ranges).collect()
    assert sorted(r["value"] for r in got) == sorted(text(0, 50))
    assert files.read_ranges(spark, [(b, 0, None)]).count() == 10


def test_carriage_returns_do_not_split(tmp_path, spark):
    p = tmp_path / "a.log"
    p.write_bytes(b"a\rb\nc\xff\n")
    assert [r["value"] for r in files.read_lines(spark, [str(p)]).collect()] == ["a\rb", "c\ufffd"]


def test_unchanged_files_are_skipped_unread(tmp_path, runner, monkeypatch):
    a, b = write(tmp_path / "a.log", text(0, 200)), write(tmp_path / "b.log.gz", text(0, 90, "other"), gzip.open)
    assert runner.run(a, b) == 290
    monkeypatch.setattr(ledger, "open_decoded", lambda *_: pytest.fail("decoded"))
    monkeypatch.setattr("builtins.open", lambda *_, **__: pytest.fail("opened"))
    plans = ledger.plan([a, b], runner.ledger)
    monkeypatch.undo()
    assert [p.read for p in plans] == [False, False] and all(p.entry.completed for p in plans)


def test_touched_file_is_told_by_its_head(tmp_path, runner):
    p = write(tmp_path / "a.log", text(100, 300))
    runner.run(p)
    os.utime(p, ns=(1, 1))
    assert runner.run(p) == 0
    size = os.path.getsize(p)
    write(p, text(300, 500))  # the same size and another head
    assert os.path.getsize(p) == size and runner.run(p) == 200


@pytest.mark.parametrize(("opener", "suffix"), [(open, ""), (gzip.open, ".gz")])
def test_interrupted_file_goes_on(tmp_path, opener, suffix):
    """An entry that is not completed: the next run reads what is left, also if the file has grown meanwhile."""
    p = write(tmp_path / f"a.log{suffix}", text(0, 400), opener)
    plans = ledger.plan([p], [])
    lines = list(files.tail_lines(p, 0, None))
    done = lines[150][0]
    part = ledger.update([], plans, {p: done}, {p})
    assert [(e.completed, e.done) for e in part] == [(False, done)]
    again = ledger.plan([p], part)[0]
    assert again.read and again.start == done
    assert [x for _, x in files.tail_lines(p, again.start, None)] == [x for _, x in lines[150:]]
    write(p, text(400, 405), opener, "ab")
    grown = ledger.plan([p], part)[0]
    assert len(list(files.tail_lines(p, grown.start, None))) == 255
    whole = ledger.update(part, [grown], {p: 10**6})
    assert [e.completed for e in whole] == [True] and not ledger.plan([p], whole)[0].read


def test_many_entries_are_planned_by_look_up(tmp_path):
    """Two thousand files against a ledger of two thousand entries: no entry is scanned for a file."""
    import time

    paths = [write(tmp_path / f"{i}.log", [f"file {i}"]) for i in range(2000)]
    entries = ledger.update([], ledger.plan(paths, []), {})
    began = time.time()
    assert not any(p.read for p in ledger.plan(paths, entries))
    assert time.time() - began < 2


def test_whole_files_and_names(tmp_path, spark):
    """Paths come back as they were, whatever is in them."""
    names = ["plain.log", "with space.log", "plus+percent%20.log", "umlaut-ä.log", "z.log.gz"]
    paths = [write(tmp_path / n, [f"in {n}", "second"], gzip.open if n.endswith("gz") else open) for n in names]
    want = {p: {f"in {n}", "second"} for p, n in zip(paths, names, strict=True)}
    got = {}
    for r in files.read_whole(spark, paths).collect():
        got.setdefault(r["path"], set()).add(r["value"])
    assert got == want
    assert files.read_whole(spark, []).count() == 0
    assert files.terminated(paths[0]) and files.terminated(write(tmp_path / "empty", []))
    (tmp_path / "open").write_bytes(b"a\nb")
    assert not files.terminated(str(tmp_path / "open"))


def test_ranges_from_a_start(tmp_path, spark):
    p = write(tmp_path / "a.log", text(0, 300))
    start = list(files.tail_lines(p, 0, None))[120][0]
    ranges = files.line_ranges(p, 5, start)
    assert len(ranges) == 5 and ranges[0][1] == start
    assert sorted(r["value"] for r in files.read_ranges(spark, ranges).collect()) == sorted(text(120, 300))
