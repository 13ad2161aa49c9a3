"""process: new log lines into the store; generate: the store into pages; all (default): both."""

from __future__ import annotations

import argparse
import logging
import os
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from . import progress
from .operators.hits import parse_lines
from .plans.store import Store
from .reporting import site
from .sources import files, ledger

log = logging.getLogger("logquarry")


def geo_ranges(spark: SparkSession, path: str | None):
    """Country ranges (first, last, country_code, country_name) from Parquet or CSV with a header, or none at all.

    Bounds are IPv4 numbers, or addresses of either kind as text.
    """
    if not path:
        return spark.createDataFrame([], "first string, last string, country_code string, country_name string")
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.schema("first string, last string, country_code string, country_name string").csv(path, header=True)
    return spark.read.parquet(path)


@dataclass
class Part:
    """One batch of a run: whole new files, ranges of files, and the files that a later part reads further."""

    whole: list[str] = field(default_factory=list)
    ranges: list[tuple[str, int, int | None]] = field(default_factory=list)
    unfinished: set[str] = field(default_factory=set)
    size: int = 0


def parts_of(plans: list[ledger.Plan], batch_bytes: int, range_bytes: int) -> list[Part]:
    """The run's work in batches of about batch_bytes stored bytes.

    New files go whole to Spark's text reader, a plain one only if it ends with a line and fits a batch. Tails, decoded
    prefixes and larger plain files are read by ranges of about range_bytes each, on line starts; those of one
    file may go over several batches, and its entry is completed with the last.
    """
    parts = [Part()]

    def room(size: int) -> Part:
        if parts[-1].size and parts[-1].size + size > batch_bytes:
            parts.append(Part())
        parts[-1].size += size
        return parts[-1]

    for p in (p for p in plans if p.read):
        path, size = p.seen.path, p.seen.size
        if p.start == 0 and (p.seen.compressed or (size <= batch_bytes and files.terminated(path))):
            room(size).whole.append(path)
        elif p.seen.compressed:
            room(size).ranges.append((path, p.start, None))
        else:
            own = files.line_ranges(path, max(1, -(-(size - p.start) // range_bytes)), p.start) if size > p.start else [(path, p.start, None)]
            for i, r in enumerate(own):
                part = room((r[2] or r[1]) - r[1])
                part.ranges.append(r)
                part.unfinished.add(path)
                if i == len(own) - 1:
                    part.unfinished.discard(path)
    return parts


def process(spark: SparkSession, cfg: settings.Config) -> int:
    """Reads what is new of the files that the globs name; returns the number of well-formed new lines.

    Each part of the run is one batch of the store, published with the ledger as it then is: a run that ends early
    has lost its last part only, and the next goes on from there.
    """
    began, count = time.time(), 0
    store = Store(spark, cfg.store, cfg.options())
    known = [ledger.Entry(**e) for e in store.manifest()["ledger"]]
    plans = ledger.plan(files.expand_globs(cfg.logs), known)
    parts = parts_of(plans, cfg.batch_bytes, cfg.range_bytes)
    done = {p.seen.path: p.start for p in plans if p.read}
    named = {os.path.abspath(p): p for p in done}
    waiting = set(done)
    total, read = sum(p.size for p in parts), 0
    for i, part in enumerate(parts):
        lines = _lines(spark, part).persist()
        try:
            for r in lines.groupBy("path").agg(F.max("stop").alias("stop"), F.sum("size").alias("size")).collect():  # a row a file of the part
                done[named.get(r["path"], r["path"])] = r["stop"] if r["stop"] is not None else r["size"]
            count += parse_lines(lines.select("id", "value")).count()
            waiting -= {*part.whole, *(r[0] for r in part.ranges)} - part.unfinished
            now = [p for p in plans if not p.read or p.seen.path not in waiting or done[p.seen.path] > p.start]
            entries = [asdict(e) for e in ledger.update(known, now, done, waiting)]
            store.add_batch(f"run-{uuid.uuid4().hex}", lines.select("id", "value"), geo_ranges(spark, cfg.geo), entries)
        finally:
            lines.unpersist()
        read, seconds = read + part.size, time.time() - began
        log.info("part %d of %d: %s lines, %s, %s passed, %s to go", i + 1, len(parts), progress.short_count(count), progress.rate(count, seconds), progress.clock(seconds), progress.eta(read, total, seconds))
    return count


def _lines(spark: SparkSession, part: Part) -> DataFrame:
    """(id, path, value, stop, size): stop for ranges, else null and size the line's bytes."""
    whole = files.read_whole(spark, part.whole).select("path", "value", F.lit(None).cast("long").alias("stop"), (F.octet_length("value") + 1).cast("long").alias("size"))
    tails = files.read_ranges(spark, part.ranges).select("path", "value", "stop", F.lit(0).cast("long").alias("size"))
    return whole.unionByName(tails).withColumn("id", F.monotonically_increasing_id())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="logquarry", description=__doc__)
    p.add_argument("command", nargs="?", choices=("process", "generate", "all"), default="all")
    p.add_argument("--config")
    p.add_argument("--logs")
    p.add_argument("--store")
    p.add_argument("--output")
    p.add_argument("--top-n", type=int, dest="top_n")
    p.add_argument("--site-host", dest="site_host")
    p.add_argument("--keep-bots", action="store_false", default=None, dest="drop_bots")
    args = vars(p.parse_args(argv))
    command, path = args.pop("command"), args.pop("config")
    cfg = settings.load(path, args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("logquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if command in ("process", "all"):
        process(spark, cfg)
        store = Store(spark, cfg.store, cfg.options())
        store.compact()
        store.vacuum()
    if command in ("generate", "all"):
        site.generate(Store(spark, cfg.store, cfg.options()), cfg.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
