"""Visits: hits of one visitor with gaps of at most 30 minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import VISIT_SECONDS


def mark_visits(hits: DataFrame, state: DataFrame | None = None, slot_seconds: int = 3600) -> DataFrame:
    """Adds new_visit: no earlier hit of the ip, or a gap of more than VISIT_SECONDS.

    Hits count in the order of their time; state (ip, last_seen) continues earlier runs. One visitor may hold a large
    share of all hits, so hits are split into time slots: gaps inside a slot come from a window over (ip, slot), and
    only each slot's first hit looks back, to the last hit of the visitor's slot before, found in a window over one
    row a slot. Reads hits twice: persist them first. `rollup.hourly_of` needs no such rows and reads once.
    """
    slot = F.floor(F.col("ts") / slot_seconds)
    rows = hits.withColumn("__slot", slot)
    rows = rows.withColumn("__before", F.lag("ts").over(W.partitionBy("ip", "__slot").orderBy("ts", "id")))
    ends = hits.groupBy("ip", slot.alias("__slot")).agg(F.max("ts").alias("__last"))
    ends = ends.withColumn("__seen", F.lag("__last").over(W.partitionBy("ip").orderBy("__slot")))
    if state is not None:
        ends = ends.join(state.select("ip", "last_seen"), "ip", "left").withColumn("__seen", F.coalesce("__seen", "last_seen"))
    out = rows.join(ends.select("ip", "__slot", "__seen"), ["ip", "__slot"], "left").withColumn("__before", F.coalesce("__before", "__seen"))
    out = out.withColumn("new_visit", F.col("__before").isNull() | (F.col("ts") - F.col("__before") > VISIT_SECONDS))
    return out.select(*hits.columns, "new_visit")


def earlier_maximum(hits: DataFrame, name: str = "seen", block: int = 1 << 20) -> DataFrame:
    """Adds the latest time of the visitor's earlier hits in arrival order (id); null for the first.

    A busy visitor's hits are split into blocks of ids: the running maximum inside a block, and that of the blocks
    before, found in a window over one row a block. Reads hits twice: persist them first.
    """
    number = F.floor(F.col("id") / block)
    rows = hits.withColumn("__block", number)
    inside = F.max("ts").over(W.partitionBy("ip", "__block").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    ends = hits.groupBy("ip", number.alias("__block")).agg(F.max("ts").alias("__top"))
    before = F.max("__top").over(W.partitionBy("ip").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("ip", "__block", before.alias("__before"))
    joined = rows.withColumn("__inside", inside).join(ends, ["ip", "__block"], "left")
    return joined.select(*hits.columns, F.greatest("__inside", "__before").alias(name))  # greatest passes over nulls


def arrival_visits(hits: DataFrame, block: int = 1 << 20) -> DataFrame:
    """new_visit against the running maximum in arrival order (id): an older hit never starts a visit."""
    top = F.col("__earlier")
    marked = earlier_maximum(hits, "__earlier", block).withColumn("new_visit", top.isNull() | (F.col("ts") - top > VISIT_SECONDS))
    return marked.drop("__earlier")


def file_visits(hits: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """new_visit of hits from several files (column file), each read on its own, over one shared state.

    Whichever file a worker reads first, a visitor's hits of all files are one sequence in time: files only name where
    a hit came from, so the result does not depend on their order.
    """
    return mark_visits(hits, state)


def visit_state(hits: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(ip, last_seen): the latest hit of each visitor, merged with an earlier state."""
    seen = hits.select("ip", F.col("ts").alias("last_seen"))
    if state is not None:
        seen = seen.unionByName(state.select("ip", "last_seen"))
    return seen.groupBy("ip").agg(F.max("last_seen").alias("last_seen"))


def prune_state(state: DataFrame, max_seen: DataFrame | None = None) -> DataFrame:
    """Drops visitors last seen more than VISIT_SECONDS before the latest of all; equal is kept.

    max_seen: one row, max_seen; by default the state's own maximum (one row, broadcast).
    """
    top = max_seen if max_seen is not None else state.agg(F.max("last_seen").alias("max_seen"))
    joined = state.join(F.broadcast(top.select("max_seen")), how="left")
    return joined.where((F.coalesce("max_seen", F.lit(0)) <= 0) | (F.col("last_seen") >= F.col("max_seen") - VISIT_SECONDS)).select("ip", "last_seen")
