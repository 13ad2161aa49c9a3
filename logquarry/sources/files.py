"""Reading log files: globs, compressed files, and only what is new of growing ones.

Whole files go through Spark's own text reader (gzip and bzip2 by suffix, plain files split by byte range).
Tails and decoded prefixes go through mapInPandas over a small table of ranges: one row names a path, how
many decoded bytes are done and where to stop; the task seeks (plain) or decodes and skips (compressed).
"""

from __future__ import annotations

import bz2
import glob
import gzip
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

CHUNK = 1 << 20
BATCH_LINES = 20_000
LINE_DDL = "path string, start long, stop long, value string"


def expand_globs(patterns: str) -> list[str]:
    """Sorted distinct files of comma-separated patterns; what is no readable file is skipped."""
    found = {p for part in patterns.split(",") if part.strip() for p in glob.glob(part.strip())}
    return sorted(p for p in found if os.path.isfile(p) and os.access(p, os.R_OK))


def compression(path: str) -> str:
    return "gzip" if path.endswith(".gz") else "bzip2" if path.endswith(".bz2") else "plain"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, value) of whole files, split at newlines only; no paths give no rows.

    id orders the lines of one file; it is unique over all.
    """
    if not paths:
        return spark.createDataFrame([], "id long, value string")
    return spark.read.option("lineSep", "\n").text(paths).select(F.monotonically_increasing_id().alias("id"), "value")


def read_whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(absolute path, value) of whole files by Spark's text reader: plain and bzip2 files are split, all of it stays in the JVM."""
    if not paths:
        return spark.createDataFrame([], "path string, value string")
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("uri"))
    path = F.call_function("url_decode", F.replace(F.regexp_replace("uri", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return lines.select(path.alias("path"), "value")


def terminated(path: str) -> bool:
    """Whether a plain file ends with a newline (or is empty)."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        return not size or (f.seek(size - 1), f.read(1))[1] == b"\n"


def open_decoded(path: str):
    """A reader of the decoded bytes; members of gzip and streams of bzip2 are read on end."""
    kind = compression(path)
    return gzip.open(path, "rb") if kind == "gzip" else bz2.open(path, "rb") if kind == "bzip2" else open(path, "rb")


def tail_lines(path: str, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(place, line without newline) of the decoded bytes from start; an unterminated last line is held back.

    stop: decoded bytes to end at (a line that starts before it is read whole), or None for the end.
    """
    with open_decoded(path) as f:
        if compression(path) == "plain":
            f.seek(start)
        else:
            left = start
            while left > 0:
                got = f.read(min(CHUNK, left))
                if not got:
                    return
                left -= len(got)
        at = start
        while stop is None or at < stop:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield at, line[:-1]
            at += len(line)


def read_ranges(spark: SparkSession, ranges: list[tuple[str, int, int | None]]) -> DataFrame:
    """(path, start, stop, value) of the lines in each (path, start, stop); one task a range."""
    if not ranges:
        return spark.createDataFrame([], LINE_DDL)
    ship_package(spark)
    table = spark.createDataFrame(ranges, "path string, start long, stop long").repartition(len(ranges), "path", "start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start, stop in pdf.itertuples(index=False):
                rows: list[tuple] = []
                for at, line in tail_lines(path, int(start), None if pd.isna(stop) else int(stop)):
                    rows.append((path, at, at + len(line) + 1, line.decode("utf-8", "replace")))
                    if len(rows) >= BATCH_LINES:
                        yield pd.DataFrame(rows, columns=["path", "start", "stop", "value"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "start", "stop", "value"])

    return table.mapInPandas(run, LINE_DDL)


def line_ranges(path: str, parts: int, start: int = 0) -> list[tuple[str, int, int]]:
    """About equal byte ranges of a plain file from start on, moved to line starts, so that each line is in one range."""
    size = os.path.getsize(path)
    edges = {start, size}
    with open(path, "rb") as f:
        for i in range(1, parts):
            f.seek(start + (size - start) * i // parts)
            f.readline()
            edges.add(min(f.tell(), size))
    order = sorted(edges)
    return [(path, a, b) for a, b in zip(order, order[1:], strict=False)]
