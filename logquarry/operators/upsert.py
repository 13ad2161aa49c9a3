"""Merging new rows into stored ones: every rule is an aggregate over both, no row is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import UNKNOWN_COUNTRY


def additive(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def union_all(*parts: DataFrame) -> DataFrame:
    """Live and archived rows together, repeats included."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_union(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, each once."""
    return union_all(*parts).distinct()


def distinct_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys' combinations, each once."""
    return rows.select(*keys).dropDuplicates()


def maximum(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.max(value).alias(value))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose keys are not in old, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def replace_latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version)))
    return rows.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def known_country(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A stored country stays unless a new one other than -- comes (the last of several by name)."""
    both = old.select(key, "country_code", F.lit(0).alias("__new")).unionByName(new.select(key, "country_code", F.lit(1).alias("__new")))
    better = F.when((F.col("__new") == 1) & (F.col("country_code") != UNKNOWN_COUNTRY[0]), F.col("country_code"))
    stored = F.when(F.col("__new") == 0, F.col("country_code"))
    return both.groupBy(key).agg(F.coalesce(F.max(better), F.max(stored), F.lit(UNKNOWN_COUNTRY[0])).alias("country_code"))


def retain(rows: DataFrame, column: str, cutoff: int) -> DataFrame:
    return rows.where(F.col(column) >= cutoff)
