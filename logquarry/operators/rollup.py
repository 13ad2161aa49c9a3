"""Rollups of hits: hourly counters and per-period counts. All are sums of partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import COUNTERS, UNKNOWN_COUNTRY, VISIT_SECONDS


def _counters() -> list:
    """Sums over a group of hits, visits apart."""
    cls, content = F.col("status_class"), F.col("content")
    return [
        F.count("*").alias("hits"), F.count_if(content == "file").alias("files"), F.count_if(content == "page").alias("pages"),
        F.sum("bytes").alias("bandwidth"), *[F.count_if(cls == c).alias(f"status_{c}") for c in ("2xx", "3xx", "4xx", "5xx")],
    ]


def hourly(marked: DataFrame) -> DataFrame:
    """Per (date, hour): counters and exact distinct visitors; needs new_visit.

    Distinct visitors come from a first grouping by (date, hour, ip): every sum is partial before the shuffle,
    and a busy hour is spread over its visitors.
    """
    per_ip = marked.groupBy("date", "hour", "ip").agg(*_counters(), F.sum(F.col("new_visit").cast("long")).alias("visits"))
    return per_ip.groupBy("date", "hour").agg(*[F.sum(n).alias(n) for n in COUNTERS], F.count("*").alias("sites"))


def hourly_of(hits: DataFrame, state: DataFrame | None = None, slot_seconds: int = 3600) -> DataFrame:
    """hourly() of hits whose visits are not marked yet, in one pass over them.

    Gaps inside a time slot come from a window over (ip, slot), so that a busy visitor is spread over time. Hits are
    then grouped by (ip, slot, date, hour); whether a slot's first hit starts a visit is decided on these groups, of
    which a visitor has a few an hour, in a window over the slots before.
    """
    slot = F.floor(F.col("ts") / slot_seconds).alias("slot")
    rows = hits.select("ip", "id", "ts", "date", "hour", "bytes", "status_class", "content", slot)
    before = F.lag("ts").over(W.partitionBy("ip", "slot").orderBy("ts", "id"))
    gap = rows.withColumn("before", before)
    groups = gap.groupBy("ip", "slot", "date", "hour").agg(
        *_counters(), F.count_if(F.col("ts") - F.col("before") > VISIT_SECONDS).alias("inner"),
        F.min(F.when(F.col("before").isNull(), F.col("ts"))).alias("first"), F.max("ts").alias("last"),
    )
    seen = F.max("last").over(W.partitionBy("ip").orderBy("slot").rangeBetween(W.unboundedPreceding, -1))
    groups = groups.withColumn("seen", seen)
    if state is not None:
        groups = groups.join(state.select("ip", "last_seen"), "ip", "left").withColumn("seen", F.coalesce("seen", "last_seen"))
    starts = F.col("first").isNotNull() & (F.col("seen").isNull() | (F.col("first") - F.col("seen") > VISIT_SECONDS))
    counted = groups.withColumn("visits", F.col("inner") + starts.cast("long"))
    per_ip = counted.groupBy("date", "hour", "ip").agg(*[F.sum(n).alias(n) for n in COUNTERS])
    return per_ip.groupBy("date", "hour").agg(*[F.sum(n).alias(n) for n in COUNTERS], F.count("*").alias("sites"))


def periods(hits: DataFrame, keys: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """(grain, period, keys, hits, sums) for months and years.

    Months are grouped from the hits, years from the months, so the hits are read and shuffled once.
    """
    sums = sums or {}
    month = hits.groupBy(F.col("month").alias("period"), *keys).agg(F.count("*").alias("hits"), *[F.sum(c).alias(n) for n, c in sums.items()])
    both = _both_grains(month, F.col("period"), *keys, "hits", *sums)
    return both.groupBy("grain", "period", *keys).agg(F.sum("hits").alias("hits"), *[F.sum(n).alias(n) for n in sums])


def _both_grains(months: DataFrame, month, *columns: str) -> DataFrame:
    """Each row of a month once as such and once for its year."""
    year = F.substring(month, 1, 4)
    grains = F.array(F.struct(F.lit("month").alias("grain"), month.alias("period")), F.struct(F.lit("year").alias("grain"), year.alias("period")))
    return months.select(F.explode(grains).alias("p"), *columns).select("p.grain", "p.period", *columns)


def url_counts(hits: DataFrame) -> DataFrame:
    return periods(hits, ["url"], {"bandwidth": "bytes"})


def address_counts(hits: DataFrame) -> DataFrame:
    """(month, ip, hits, bytes): what countries are joined to, once an address and month instead of once a hit."""
    return hits.groupBy("month", "ip").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def host_counts(located: DataFrame) -> DataFrame:
    """(grain, period, ip, hits, bandwidth, country_code) of located address counts: a known country wins over the unknown."""
    known = F.when(F.col("country_code") != UNKNOWN_COUNTRY[0], F.col("country_code"))
    both = _both_grains(located.select("month", "ip", "n", "bytes", known.alias("cc")), F.col("month"), "ip", "n", "bytes", "cc")
    summed = both.groupBy("grain", "period", "ip").agg(F.sum("n").alias("hits"), F.sum("bytes").alias("bandwidth"), F.max("cc").alias("cc"))
    return summed.select("grain", "period", "ip", "hits", "bandwidth", F.coalesce("cc", F.lit(UNKNOWN_COUNTRY[0])).alias("country_code"))


def referrer_counts(hits: DataFrame, site_host: str | None = None) -> DataFrame:
    """Hits per referring host; the site's own host is left out by exact comparison."""
    named = hits.where(F.col("ref_host").isNotNull())
    if site_host:
        named = named.where(F.col("ref_host") != site_host)
    return periods(named, ["ref_host"])


def agent_counts(hits: DataFrame) -> DataFrame:
    return periods(hits, ["family"])


def country_counts(located: DataFrame) -> DataFrame:
    """(grain, period, country_code, hits) of located address counts."""
    months = located.groupBy("month", "country_code").agg(F.sum("n").alias("n"))
    both = _both_grains(months, F.col("month"), "country_code", "n")
    return both.groupBy("grain", "period", "country_code").agg(F.sum("n").alias("hits"))


def status_counts(hits: DataFrame) -> DataFrame:
    return periods(hits, ["status"])


def method_counts(hits: DataFrame) -> DataFrame:
    return periods(hits, ["method"])


def protocol_counts(hits: DataFrame) -> DataFrame:
    return periods(hits, ["proto"])


def daily_visitors(hits: DataFrame) -> DataFrame:
    """(date, ip), each once."""
    return hits.select("date", "ip").distinct()


def distinct_hosts(hits: DataFrame) -> DataFrame:
    """(ip), each once."""
    return hits.select("ip").distinct()


def distinct_sites(hits: DataFrame) -> DataFrame:
    """(grain, period, sites): exact distinct visitors by day, month, year and in all."""
    grains = F.array(
        F.struct(F.lit("day").alias("grain"), F.col("date").alias("period")), F.struct(F.lit("month").alias("grain"), F.substring("date", 1, 7).alias("period")),
        F.struct(F.lit("year").alias("grain"), F.substring("date", 1, 4).alias("period")), F.struct(F.lit("all").alias("grain"), F.lit("__all__").alias("period")),
    )
    days = daily_visitors(hits)  # smaller than the hits before they are fanned out
    return days.select(F.explode(grains).alias("g"), "ip").select("g.grain", "g.period", "ip").distinct().groupBy("grain", "period").agg(F.count("*").alias("sites"))


def country_names(seen: DataFrame) -> DataFrame:
    """(country_code, country_name): a name other than Unknown wins."""
    known = F.when(F.col("country_name") != UNKNOWN_COUNTRY[1], F.col("country_name"))
    return seen.groupBy("country_code").agg(F.coalesce(F.min(known), F.lit(UNKNOWN_COUNTRY[1])).alias("country_name"))
