"""Rankings: top k, pruning and head-and-other. Every order ends with the key, so ties are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(key: str, *metrics: str) -> list[Column]:
    return [F.desc(m) for m in metrics] + [F.asc(key)]


def top(counts: DataFrame, key: str, n: int, *metrics: str) -> DataFrame:
    """The n best rows: a per-partition heap, then one of the partitions' bests."""
    return counts.orderBy(*_order(key, *metrics)).limit(n)


def top_per_period(counts: DataFrame, key: str, n: int, *metrics: str) -> DataFrame:
    """The n best rows of each (grain, period); the row-number limit is applied before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy("grain", "period").orderBy(*_order(key, *metrics)))
    return counts.withColumn("rn", rank).where(F.col("rn") <= n)


def latest(counts: DataFrame) -> DataFrame:
    """(grain, latest): the last period of each grain."""
    return counts.groupBy("grain").agg(F.max("period").alias("latest"))


def not_latest(counts: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(latest(counts)), "grain").where("period < latest").drop("latest")  # a row a grain


def merge_and_trim(parts: DataFrame, key: str, k: int, *metrics: str) -> DataFrame:
    """Partial counts summed, then the k best of each period."""
    summed = parts.groupBy("grain", "period", key).agg(*[F.sum(m).alias(m) for m in metrics])
    return top_per_period(summed, key, k, *metrics).drop("rn")


def of_grain(counts: DataFrame, grain: str) -> DataFrame:
    return counts.where(F.col("grain") == grain)


def _best_of_old(counts: DataFrame, key: str, n: int, *metrics: str) -> DataFrame:
    """The n best rows of each period before the latest, and all of the latest: those are ranked one by one, so none waits for another."""
    alone = F.when(F.col("period") >= F.col("latest"), F.col(key))
    rank = F.row_number().over(W.partitionBy("grain", "period", alone).orderBy(*_order(key, *metrics)))
    return counts.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn", "latest")


def pretrim(counts: DataFrame, key: str, n: int, latest_periods: DataFrame) -> DataFrame:
    """Periods before the latest keep the union of the n best by hits and the n best by bandwidth."""
    known = counts.join(F.broadcast(latest_periods), "grain")  # a row a grain
    best = [_best_of_old(known, key, n, *metrics) for metrics in (("hits", "bandwidth"), ("bandwidth", "hits"))]
    return best[0].unionByName(best[1]).distinct()


def prune(counts: DataFrame, key: str, n: int, k: int | None, *metrics: str) -> DataFrame:
    """Old periods keep the n best; the latest of each grain keeps k (all, if k is None). n = 0 prunes nothing.

    One rank with a plain limit, which Spark applies before the shuffle too. With k, the latest periods are found among
    the rows that are left (at most n or k a period); without, in a pass of their own.
    """
    if n <= 0:
        return counts
    if k is None:
        return _best_of_old(counts.join(F.broadcast(latest(counts)), "grain"), key, n, *metrics)
    best = top_per_period(counts, key, max(n, k), *metrics)
    last = F.max("period").over(W.partitionBy("grain"))
    return best.withColumn("latest", last).where(F.col("rn") <= F.when(F.col("period") == F.col("latest"), k).otherwise(n)).drop("rn", "latest")


def head_and_other(counts: DataFrame, key: str, n: int, by: tuple[str, ...] = ("grain", "period")) -> DataFrame:
    """The n most frequent keys of each group and one row Other for the rest, with position and percent.

    The rest is the group's sum less its head's, so no group is ranked beyond its n best.
    """
    total = counts.groupBy(*by).agg(F.sum("hits").alias("total"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*_order(key, "hits")))
    head = counts.withColumn("position", rank).where(F.col("position") <= n)
    head = head.select(*by, F.col(key).cast("string").alias("label"), "position", "hits").join(total, list(by))
    rest = head.groupBy(*by).agg((F.first("total") - F.sum("hits")).alias("hits"), F.first("total").alias("total"))
    rest = rest.select(*by, F.lit("Other").alias("label"), F.lit(n + 1).alias("position"), "hits", "total")
    out = head.unionByName(rest).where("hits > 0")
    return out.withColumn("percent", F.round(F.col("hits") / F.col("total") * 1000) / 10).drop("total")
