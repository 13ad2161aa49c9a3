"""Mergeable distinct counts and heavy hitters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package


def day_sketches(hits: DataFrame, precision: int = 14) -> DataFrame:
    """(date, sketch): one HyperLogLog sketch a day; all other scopes are unions of these."""
    return hits.groupBy("date").agg(F.hll_sketch_agg("ip", F.lit(precision)).alias("sketch"))


def scope_sketches(days: DataFrame) -> DataFrame:
    """(grain, period, sketch) for day, month, year and all, from day sketches alone."""
    date = F.col("date")
    scopes = F.array(
        F.struct(F.lit("day").alias("grain"), date.alias("period")), F.struct(F.lit("month").alias("grain"), F.substring(date, 1, 7).alias("period")),
        F.struct(F.lit("year").alias("grain"), F.substring(date, 1, 4).alias("period")), F.struct(F.lit("all").alias("grain"), F.lit("__all__").alias("period")),
    )
    return days.select(F.explode(scopes).alias("s"), "sketch").groupBy("s.grain", "s.period").agg(F.hll_union_agg("sketch").alias("sketch"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Union of sketches with the same (grain, period) over several runs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("grain", "period").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """Adds sites, which follows from the set of visitors alone, not from how often and in what order sketches were merged.

    A sketch that was never merged with another of its kind also carries a running estimate, which depends on the order of
    its input and is gone after a merge. The union with itself keeps all registers and leaves only the estimate from these.
    """
    return sketches.withColumn("sites", F.hll_sketch_estimate(F.hll_union("sketch", "sketch")))


def approx_heavy_hitters(df: DataFrame, item: str, k: int, tracked: int = 10_000) -> DataFrame:
    """(item, hits) of about the k most frequent items of the whole frame, in bounded memory; hits only."""
    top = df.agg(F.expr(f"approx_top_k(`{item}`, {int(k)}, {int(tracked)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(item), F.col("t.count").alias("hits"))


def bounded_hitters(hits: DataFrame, item: str, tracked: int = 2000) -> DataFrame:
    """(period, item, hits, bandwidth, error) of every month's frequent items, in memory bounded by `tracked` a month and task.

    Each task keeps its months' counts and, whenever a month has more than twice `tracked` items, takes the count of the
    `tracked`-th off all of them and drops what is left with none; what it took off is that month's error. Counts of all
    tasks are added. hits is at most the true count and at least that less the error, which is at most the month's
    hits divided by `tracked`; so every item above that share is there. Its bandwidth is that of the hits that a task
    saw while it kept the item.
    """

    def trimmed(counts: pd.DataFrame, errors: dict) -> pd.DataFrame:
        kept = []
        for period, own in counts.groupby("period", sort=False):
            if len(own) > 2 * tracked:
                off = int(own["hits"].nlargest(tracked).iloc[-1])
                errors[period] = errors.get(period, 0) + off
                own = own.assign(hits=own["hits"] - off)
                own = own[own["hits"] > 0]
            kept.append(own)
        return pd.concat(kept) if kept else counts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, errors = None, {}
        for b in batches:
            new = b.groupby(["period", "item"], sort=False, as_index=False).agg(hits=("bytes", "size"), bandwidth=("bytes", "sum"))
            both = new if counts is None else pd.concat([counts, new]).groupby(["period", "item"], sort=False, as_index=False).sum()
            counts = trimmed(both, errors)
        if counts is not None:
            yield counts.assign(error=0)[["period", "item", "hits", "bandwidth", "error"]]
            yield pd.DataFrame([(p, None, 0, 0, e) for p, e in errors.items()], columns=["period", "item", "hits", "bandwidth", "error"])

    ship_package(hits.sparkSession)
    rows = hits.select(F.col("month").alias("period"), F.col(item).alias("item"), "bytes").where("item is not null")
    parts = rows.mapInPandas(run, "period string, item string, hits long, bandwidth long, error long")
    errors = parts.groupBy("period").agg(F.sum("error").alias("error"))
    summed = parts.where("item is not null").groupBy("period", "item").agg(F.sum("hits").alias("hits"), F.sum("bandwidth").alias("bandwidth"))
    return summed.join(errors, "period").select("period", F.col("item").alias(item), "hits", "bandwidth", "error")
