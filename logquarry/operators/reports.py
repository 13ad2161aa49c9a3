"""Report queries over the rollups: totals, distributions, averages, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..schema import COUNTERS, UNKNOWN_COUNTRY
from . import topk


def _sums(names=(*COUNTERS, "sites")):
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names]


def in_period(hourly: DataFrame, period: str | None) -> DataFrame:
    """Rows whose date starts with YYYY or YYYY-MM (a prefix filter that reaches the Parquet scan)."""
    return hourly if period is None else hourly.where(F.col("date").startswith(period + "-"))


def daily(hourly: DataFrame, period: str | None = None) -> DataFrame:
    return in_period(hourly, period).groupBy("date").agg(*_sums())


def hours_of_day(hourly: DataFrame, period: str | None = None) -> DataFrame:
    """24 rows, zero where there is nothing; sites is the sum of the hourly ones."""
    spark = hourly.sparkSession
    seen = in_period(hourly, period).groupBy("hour").agg(*_sums())
    dense = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return dense.join(seen, "hour", "left").select("hour", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTERS, "sites")])


def totals(hourly: DataFrame, period: str | None = None) -> DataFrame:
    return in_period(hourly, period).agg(*_sums(COUNTERS))


def months(hourly: DataFrame, year: str | None = None) -> DataFrame:
    return in_period(hourly, year).groupBy(F.substring("date", 1, 7).alias("month")).agg(*_sums(COUNTERS))


def years(hourly: DataFrame) -> DataFrame:
    year = F.substring("date", 1, 4)
    return hourly.where(year.try_cast("int") > 0).groupBy(year.alias("year")).agg(*_sums(COUNTERS))


def with_sites(rows: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Adds the unique visitors of each row's period: one join instead of a look-up for each row."""
    return rows.join(sites.select(F.col("period").alias(key), "sites"), key, "left").withColumn("sites", F.coalesce("sites", F.lit(0)).cast("long"))


def site_fallback(periods: DataFrame, estimates: DataFrame, hosts: DataFrame) -> DataFrame:
    """(period, sites): the sketch's estimate, else the number of host rows."""
    counted = hosts.groupBy("period").agg(F.count("*").alias("counted"))
    joined = periods.select("period").distinct().join(estimates.select("period", "estimate"), "period", "left").join(counted, "period", "left")
    return joined.select("period", F.coalesce("estimate", "counted", F.lit(0)).cast("long").alias("sites"))


def all_time_sites(estimates: DataFrame, all_hosts: DataFrame, host_rows: DataFrame) -> DataFrame:
    """One row: the estimate of the whole, else the host set if any, else distinct host rows."""
    a = estimates.where("period = '__all__'").agg(F.max("estimate").alias("a"))
    b = all_hosts.select("ip").distinct().agg(F.count("*").alias("b"))
    c = host_rows.select("ip").distinct().agg(F.count("*").alias("c"))
    return a.crossJoin(b).crossJoin(c).select(F.coalesce("a", F.when(F.col("b") > 0, F.col("b")), "c").cast("long").alias("sites"))  # three single rows


def daily_averages(hourly: DataFrame, period: str | None = None) -> DataFrame:
    """Floor of the mean over days with data, and the maximum, of six counters."""
    names = ("hits", "files", "pages", "visits", "sites", "bandwidth")
    days = daily(hourly, period)
    n = F.count("*")
    mean = [F.coalesce(F.floor(F.sum(c) / n), F.lit(0)).cast("long").alias(f"avg_{c}") for c in names]
    return days.agg(*mean, *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"max_{c}") for c in names])


def hourly_averages(hourly: DataFrame, period: str | None = None) -> DataFrame:
    """Mean hits over existing (date, hour) rows, half away from zero, and the maximum."""
    rows = in_period(hourly, period)
    return rows.agg(F.coalesce(F.round(F.avg("hits")), F.lit(0)).cast("long").alias("avg_hits"), F.coalesce(F.max("hits"), F.lit(0)).cast("long").alias("max_hits"))


def all_time(counts: DataFrame, key: str) -> DataFrame:
    return counts.where("grain = 'year'").groupBy(key).agg(F.sum("hits").alias("hits"))


def available_periods(hourly: DataFrame) -> DataFrame:
    """(grain, period) of years and months with data, malformed ones left out."""
    good = hourly.where(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-") & (F.substring("date", 1, 4).try_cast("int") > 0)).select(F.substring("date", 1, 7).alias("m")).distinct()
    both = F.array(F.struct(F.lit("month").alias("grain"), F.col("m").alias("period")), F.struct(F.lit("year").alias("grain"), F.substring("m", 1, 4).alias("period")))
    return good.select(F.explode(both).alias("p")).select("p.*").distinct()


def with_percent(rows: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Adds percent of hits; the denominator is the sum over these rows (one row, broadcast), or the given one."""
    total = rows.agg(F.sum("hits").alias("__total")) if total is None else total.select(F.col("hits").alias("__total"))
    out = rows.join(F.broadcast(total), how="cross")
    return out.withColumn("percent", fmt.percent(F.col("hits"), F.col("__total"))).drop("__total")


def with_country_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Left join to the country names; unknown ones are -- / Unknown."""
    code, name = UNKNOWN_COUNTRY
    out = rows.join(names.select("country_code", "country_name"), "country_code", "left")
    return out.withColumn("country_code", F.coalesce("country_code", F.lit(code))).withColumn("country_name", F.coalesce("country_name", F.lit(name)))


def chart_data(days: DataFrame) -> DataFrame:
    """(month, labels, hits): a month's day labels and hits in the order of the days, at most 31 of each."""
    rows = days.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.array_sort(F.collect_list(F.struct("date", "hits"))).alias("rows"))
    labels = F.transform("rows", lambda r: fmt.day_label(r["date"]))
    return rows.select("month", F.array_join(labels, ",").alias("labels"), F.array_join(F.transform("rows", lambda r: r["hits"].cast("string")), ",").alias("hits"))


def share_data(counts: DataFrame, key: str, n: int) -> DataFrame:
    """(grain, period, labels, hits) of a share chart: the n most frequent keys with their percent, and Other, in their order."""
    rows = topk.head_and_other(counts, key, n)
    text = F.concat(F.col("label"), F.lit(" ("), F.format_string("%.1f", F.col("percent")), F.lit("%)"))
    listed = rows.groupBy("grain", "period").agg(F.array_sort(F.collect_list(F.struct("position", text.alias("text"), "hits"))).alias("rows"))  # n + 1 at most
    return listed.select("grain", "period", F.array_join(F.transform("rows", lambda r: r["text"]), ",").alias("labels"), F.array_join(F.transform("rows", lambda r: r["hits"].cast("string")), ",").alias("hits"))


def activity_data(days: DataFrame) -> DataFrame:
    """(month, labels, hits, pages, files, megabytes) of an activity chart, in the order of the days, at most 31 of each."""
    fields = ("hits", "pages", "files")
    size = F.format_string("%.2f", fmt.megabytes(F.col("bandwidth"))).alias("megabytes")
    rows = days.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.array_sort(F.collect_list(F.struct("date", *[F.col(c).cast("string").alias(c) for c in fields], size))).alias("rows"))
    series = [F.array_join(F.transform("rows", lambda r: r[c]), ",").alias(c) for c in (*fields, "megabytes")]
    return rows.select("month", F.array_join(F.transform("rows", lambda r: fmt.day_label(r["date"])), ",").alias("labels"), *series)
