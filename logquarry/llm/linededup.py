"""Line dedup by pairs of lines, or by content-defined chunks of lines.

The query and the pipeline's stage remove whole passages (PASSAGES): every two consecutive lines that occurred before
(smaller doc_id, then place) go, so a repeated passage of two and more lines goes to its last line wherever
it begins and ends, and each of its lines stays where the passage was first. A repeated single line stays.

By chunks (CHUNKS), less goes: a rolling hash over the hashes of the last lines decides where a chunk ends, so boundaries depend on
the lines near them only and survive insertions before them. Chunks of two and more lines that occur more than
once in the corpus are removed everywhere but at their first occurrence (smallest doc_id, then place), after the
bytes of both have been compared. Lines are split at the newline character and compared unchanged.

Rows: a null text stays null and has no lines; an empty text has one empty line. A document is known by its doc_id and
its text's hash: rows that are equal in both are one document and lose the same; rows of one doc_id with other texts
are documents of their own, in the order of that hash; a null doc_id sorts first. A document all of whose chunks go keeps
its row, with an empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import cut, doc_key, mix64, text_bytes, written

#: Lines in the rolling hash, one boundary in DIVISOR places, and lines of a chunk at least and at most.
ROLL, DIVISOR, LEAST, MOST = 2, 2, 2, 16


def chunk_ends(hashes: list[int]) -> list[int]:
    """Where the chunks of a text end, as numbers of lines."""
    h = np.array(hashes, np.uint64)
    with np.errstate(over="ignore"):
        roll = h.copy()
        for j in range(1, ROLL):
            roll[j:] += h[:-j] * np.uint64(0x9E3779B97F4A7C15**j % 2**64)
    cuts = (mix64(roll) % np.uint64(DIVISOR) == 0).tolist()
    ends, start = [], 0
    for i, c in enumerate(cuts, 1):
        if (c and i - start >= LEAST) or i - start >= MOST:
            ends.append(i)
            start = i
    if start < len(cuts):
        ends.append(len(cuts))
    return ends


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk of a text."""
    from xxhash import xxh3_64_intdigest

    lines = text.split(b"\n")
    if len(lines) < LEAST:
        return [(0, len(lines), text)]
    out, start = [], 0
    for end in chunk_ends([xxh3_64_intdigest(x) for x in lines]):
        out.append((start, end - start, b"\n".join(lines[start:end])))
        start = end
    return out


def windows(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, 2, bytes) of every two consecutive lines of a text."""
    lines = text.split(b"\n")
    return [(i, 2, a + b"\n" + b) for i, (a, b) in enumerate(zip(lines, lines[1:], strict=False))]


#: What is held against the corpus: the chunks of a text, or every passage by its pairs of lines.
CHUNKS, PASSAGES = "chunks", "passages"


def _pieces(by: str):
    return windows if by == PASSAGES else chunks


def body_hash(body: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(body)


def row_mark():
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text_bytes())


def repeated(docs: DataFrame, by: str = CHUNKS, hash_of: Callable[[bytes], int] = body_hash) -> DataFrame:
    """(doc, mark, drop): for each document with repeats, the places of the chunks (or pairs of lines) to remove."""
    ship_package(docs.sparkSession)
    pieces = _pieces(by)
    keyed = docs.where("text is not null").select(doc_key().alias("doc"), row_mark().alias("mark"), text_bytes().alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(*(c.to_pylist() for c in b.columns), strict=True)
            rows = [((d, m, i), body) for d, m, t in texts for i, (_, n, body) in enumerate(pieces(t)) if n >= LEAST]
            lowest: dict[bytes, tuple[int, int, int]] = {}
            for place, body in rows:
                if body not in lowest or place < lowest[body]:
                    lowest[body] = place
            hashes = np.fromiter((hash_of(body) for _, body in rows), np.uint64, len(rows))
            settled = [place != lowest[body] for place, body in rows]
            places = [pa.array([place[j] for place, _ in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *places, pa.array(settled, pa.bool_())], ["hash", "doc", "mark", "place", "settled"])

    # A batch settles its own repeats, byte by byte; only their first goes on, so a chunk that very many documents share arrives once a batch.
    all_chunks = written(keyed.mapInArrow(hashed, "hash long, doc long, mark long, place int, settled boolean"))
    left = all_chunks.where("not settled").drop("settled")
    at = F.struct("doc", "mark", "place")
    first = cut(left.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("hash", "first"))
    marks = left.join(first, "hash").select("doc", "mark", "hash", "place", (at == F.col("first")).alias("is_first"))
    marked = marks.distinct().groupBy("doc", "mark").agg(F.collect_list(F.struct("hash", "place", "is_first")).alias("marks"))  # a document's own chunks

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, m, t, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = pieces(t)
                rows += [(x["hash"], d, m, x["place"], x["is_first"], own[x["place"]][2]) for x in marks]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["hash", "doc", "mark", "place", "is_first", "body"])

    found = keyed.join(marked, ["doc", "mark"]).select("doc", "mark", "text", "marks")
    found = written(found.mapInArrow(bodies, "hash long, doc long, mark long, place int, is_first boolean, body binary"))
    source = found.where("is_first").groupBy("hash").agg(F.first("body").alias("source"))
    told = found.where("not is_first").join(written(source), "hash").withColumn("same", F.col("body") == F.col("source"))
    only = [F.when(~F.col("same"), F.col(c)).alias(c) for c in ("hash", "body")]
    later = written(told.select("doc", "mark", "place", "same", *only))  # small: bodies of colliding hashes only
    other = later.where("not same")  # equal hashes of other bytes: held against each other by their bytes
    own = other.groupBy("hash", "body").agg(F.min(at).alias("first")).alias("o")
    again = other.alias("r").join(own, F.expr("r.hash = o.hash AND r.body = o.body")).select("r.doc", "r.mark", "r.place", "o.first")
    gone = later.where("same").select("doc", "mark", "place").unionByName(again.where(at != F.col("first")).select("doc", "mark", "place"))
    gone = gone.unionByName(all_chunks.where("settled").select("doc", "mark", "place"))
    return gone.distinct().groupBy("doc", "mark").agg(F.collect_list("place").alias("drop"))


def _left(texts: pd.Series, drops: pd.Series, by: str) -> pd.DataFrame:
    out = []
    for t, drop in zip(texts, drops, strict=True):
        if drop is None or not len(drop):
            out.append((None, t.count(b"\n") + 1, 0))
            continue
        if by == PASSAGES:
            lines, places = t.split(b"\n"), set(map(int, drop))
            gone = places | {i + 1 for i in places}
            kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
            out.append((kept.decode("utf-8", "replace"), len(lines), sum(i < len(lines) for i in gone)))
            continue
        gone, all_chunks = set(map(int, drop)), chunks(t)
        kept = b"\n".join(body for i, (_, _, body) in enumerate(all_chunks) if i not in gone)
        n = sum(c for _, c, _ in all_chunks)
        out.append((kept.decode("utf-8", "replace"), n, sum(c for i, (_, c, _) in enumerate(all_chunks) if i in gone)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


def dedup(docs: DataFrame, by: str = CHUNKS, hash_of: Callable[[bytes], int] = body_hash) -> DataFrame:
    """docs with the text that is left, n_lines and n_removed (in place of columns so named); all others as they were."""
    docs = docs.drop("n_lines", "n_removed")
    drop = repeated(docs, by, hash_of).select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("drop").alias("__drop"))
    joined = docs.withColumn("__doc", doc_key()).withColumn("__mark", row_mark()).join(drop, ["__doc", "__mark"], "left")

    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        return _left(texts, drops, by)

    cleaned = joined.withColumn("__w", F.pandas_udf(without, "text string, n_lines long, n_removed long").asNondeterministic()(text_bytes(), F.col("__drop")))
    none = F.col("text").isNull()
    return cleaned.select(
        *[F.when(none, None).otherwise(F.coalesce("__w.text", "text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(none, 0).otherwise(F.col("__w.n_lines")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.col("__w.n_removed")).cast("long").alias("n_removed"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256)."""
    out = dedup(docs.select("doc_id", "text"), PASSAGES)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(text_bytes(), 256).alias("kept_sha256"))
