"""The parse ledger: which bytes of which files are done, and what to read next.

A file is recognised by path and inode, by the hash of the head of its stored bytes, and by the hash of the head of
its decoded bytes. The planner looks at every file before any is read, so its decisions do not depend on
their order. Ledgers are small (a row a file): Parquet in the store, plain rows here.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property

from .files import compression, open_decoded

HEAD = 8192


@dataclass(frozen=True)
class Entry:
    """What is known of a file after a run. done: decoded bytes read; retired: no longer at this path or shrunk."""

    path: str
    inode: int
    stored_size: int
    mtime_ns: int
    stored_head: int | None
    decoded_head: int | None
    done: int
    completed: bool
    retired: bool = False


LEDGER_DDL = "path string, inode long, stored_size long, mtime_ns long, stored_head long, decoded_head long, done long, completed boolean, retired boolean"


class Seen:
    """A file as it is now. Its heads are read, and decoded, only when they are asked for."""

    def __init__(self, path: str):
        s = os.stat(path)
        self.path, self.inode, self.size, self.mtime_ns = path, s.st_ino, s.st_size, s.st_mtime_ns

    @property
    def compressed(self) -> bool:
        return compression(self.path) != "plain"

    @cached_property
    def stored_head(self) -> int | None:
        with open(self.path, "rb") as f:
            return head_hash(f.read(HEAD))

    @cached_property
    def decoded_head(self) -> int | None:
        if not self.compressed:
            return self.stored_head
        with open_decoded(self.path) as f:
            return head_hash(f.read(HEAD))


@dataclass(frozen=True)
class Plan:
    """start: decoded bytes to pass over; read: whether there is anything to read; retired: entries to archive."""

    seen: Seen
    read: bool
    start: int
    retired: tuple[Entry, ...] = ()
    entry: Entry | None = None  # the row to write for a file that is skipped


def head_hash(data: bytes) -> int | None:
    """XXH3 of the first HEAD bytes as a signed long; none of nothing."""
    from xxhash import xxh3_64_intdigest

    if not data:
        return None
    value = xxh3_64_intdigest(data[:HEAD])
    return value - (1 << 64) if value >> 63 else value


def _best(entries: Iterable[Entry]) -> Entry | None:
    return max(entries, key=lambda e: (e.completed, e.done), default=None)


class Known:
    """The ledger by what its entries are looked up by."""

    def __init__(self, entries: Iterable[Entry]):
        self.paths: dict[str, Entry] = {}
        self.inodes: dict[int, list[Entry]] = defaultdict(list)
        self.stored: dict[tuple, list[Entry]] = defaultdict(list)
        self.decoded: dict[int | None, list[Entry]] = defaultdict(list)
        for e in entries:
            if not e.retired:
                self.paths.setdefault(e.path, e)
                self.inodes[e.inode].append(e)
            self.stored[e.stored_head, e.stored_size].append(e)
            self.decoded[e.decoded_head].append(e)


def plan_file(seen: Seen, ledger: Known | list[Entry]) -> Plan:
    """What to do with one file, from the ledger of all earlier runs.

    A file that was read to its end and has the inode, size and time it had then is skipped unread. Else its own history
    counts first (same inode, here or under another path), then content: a file whose head and size were completed
    elsewhere is a copy and is skipped; one whose head was begun elsewhere goes on from there. An entry that is not
    completed (a run that ended early) goes on from the bytes it had done.
    """
    known = ledger if isinstance(ledger, Known) else Known(ledger)
    here = known.paths.get(seen.path)
    moved = next((e for e in known.inodes[seen.inode] if e.path != seen.path), None)
    own = here if here and here.inode == seen.inode else moved
    retired = [e for e in (here,) if e and (e.inode != seen.inode or seen.size < e.stored_size)]
    if moved and moved is own:
        retired.append(moved)

    def skip(model: Entry, unread: bool = False) -> Plan:
        heads = (model.stored_head, model.decoded_head) if unread else (seen.stored_head, seen.decoded_head)
        done = Entry(seen.path, seen.inode, seen.size, seen.mtime_ns, *heads, model.done, True)
        return Plan(seen, False, model.done, tuple(retired), done)

    shrunk = own is not None and seen.size < own.stored_size
    if own and not shrunk:
        if own.completed and seen.size == own.stored_size and own.mtime_ns == seen.mtime_ns:
            return skip(own, unread=True)
        if not own.completed and own.stored_head in (None, seen.stored_head):
            return Plan(seen, True, own.done, tuple(retired))
        grown = seen.size > own.stored_size
        same_head = seen.stored_head == own.stored_head or (own.stored_size < HEAD and grown and not seen.compressed)
        if own.completed and not grown and seen.stored_head == own.stored_head:
            return skip(own)
        if grown and (same_head or seen.compressed):
            return Plan(seen, True, own.done, tuple(retired))
        return Plan(seen, True, 0 if seen.stored_head != own.stored_head else own.done, tuple(retired))

    if seen.stored_head is None:
        return Plan(seen, True, 0, tuple(retired))
    copies = [e for e in known.stored[seen.stored_head, seen.size] if e.completed]
    alike = known.decoded[seen.decoded_head]
    if seen.compressed and not copies:  # a compressed copy of a plain file that was read to its end
        plain = [e for e in alike if e.completed and compression(e.path) == "plain"]
        if plain:
            whole = _decoded_size(seen.path)
            same = [e for e in plain if e.done == whole]
            if same:
                return skip(_best(same))
    if copies and not shrunk:
        return skip(_best(copies))
    begun = None if shrunk else _best(alike)
    if begun and (seen.compressed or begun.done <= seen.size):
        return Plan(seen, True, begun.done, tuple(retired))
    return Plan(seen, True, 0, tuple(retired))


def _decoded_size(path: str) -> int:
    total = 0
    with open_decoded(path) as f:
        while got := f.read(1 << 20):
            total += len(got)
    return total


def plan(paths: list[str], ledger: list[Entry]) -> list[Plan]:
    known = Known(ledger)
    return [plan_file(Seen(p), known) for p in paths]


def after(plan: Plan, done: int, completed: bool = True) -> Entry:
    """The entry of a file read up to `done` decoded bytes."""
    s = plan.seen
    return Entry(s.path, s.inode, s.size, s.mtime_ns, s.stored_head, s.decoded_head, done, completed)


def update(ledger: list[Entry], plans: list[Plan], done: dict[str, int], unfinished: frozenset[str] | set[str] = frozenset()) -> list[Entry]:
    """The ledger after a run, or after a part of it: retired entries stay as such, live ones are replaced by path.

    Files of `unfinished` are read further by a later part; their entries say how far they were read.
    """
    gone = {e for p in plans for e in p.retired}
    fresh = {p.seen.path: after(p, done.get(p.seen.path, p.start), p.seen.path not in unfinished) if p.read else p.entry for p in plans}
    kept = [replace(e, retired=True) if e in gone else e for e in ledger if e in gone or e.retired or e.path not in fresh]
    return list(dict.fromkeys(kept)) + list(fresh.values())
