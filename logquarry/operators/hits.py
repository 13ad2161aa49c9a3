"""Raw lines to hits: parse, classify, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enrich, parsing


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: what uses it later, filters above all, does not repeat its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Well-formed lines as records (id, ip, time, method, path, proto, status, bytes, referer, user_agent); others are dropped."""
    got = once(lines.select("id", "value"), "f", parsing.split_line(F.col("value"))).where(F.size("f") == len(parsing.FIELDS))
    raw = got.select("id", *[F.get("f", i).alias(n) for i, n in enumerate(parsing.FIELDS)])
    return raw.select(
        "id", "ip", "time", "method", "path", "proto", F.col("status").cast("int").alias("status"),
        parsing.number_of_bytes(F.col("bytes")).alias("bytes"),
        parsing.dash_to_empty(F.col("referer")).alias("referer"), parsing.dash_to_empty(F.col("user_agent")).alias("user_agent"),
    )


def to_hits(records: DataFrame) -> DataFrame:
    """Records with an existing wall-clock time, with all derived columns."""
    time, status = F.col("time"), F.col("status")
    url = parsing.strip_query(F.col("path"))
    dated = once(records, "date", parsing.iso_date(time)).where(parsing.wall_clock_ok(time, F.col("date")))
    named = once(dated, "family", enrich.family(F.col("user_agent")))
    out = named.select(
        "id", parsing.ip_key(F.col("ip")).alias("ip"), parsing.epoch(time, F.col("date")).alias("ts"), "date",
        F.substring(time, 13, 2).cast("int").alias("hour"), url.alias("url"), parsing.method_class(F.col("method")).alias("method"),
        parsing.protocol_class(F.col("proto")).alias("proto"), "status", parsing.status_class(status).alias("status_class"),
        parsing.content_kind(status, url).alias("content"), "bytes", parsing.referrer_host(F.col("referer")).alias("ref_host"),
        "family", enrich.is_bot(F.col("user_agent"), F.col("family")).alias("is_bot"),
    )
    return out.withColumn("month", F.substring("date", 1, 7)).withColumn("year", F.substring("date", 1, 4))


def without_bots(hits: DataFrame) -> DataFrame:
    return hits.where(~F.col("is_bot"))


def hits(lines: DataFrame, drop_bots: bool = True) -> DataFrame:
    out = to_hits(parse_lines(lines))
    return without_bots(out) if drop_bots else out


def line_counts(lines: DataFrame) -> DataFrame:
    """One row: lines read, parsed (bots and bad times included), with a valid time, bots among those, kept."""
    split = once(lines.select("value"), "f", parsing.split_line(F.col("value")))
    parsed = F.size("f") == len(parsing.FIELDS)
    fields = once(split, "agent", parsing.dash_to_empty(F.get("f", 8)))
    fields = once(fields, "family", enrich.family(F.col("agent")))
    time = F.get("f", 1)
    marked = fields.select(
        parsed.alias("parsed"), (parsed & parsing.wall_clock_ok(time, parsing.iso_date(time))).alias("dated"),
        F.coalesce(enrich.is_bot(F.col("agent"), F.col("family")), F.lit(False)).alias("bot"),
    )
    return marked.agg(
        F.count("*").alias("lines"), F.count_if("parsed").alias("parsed"), F.count_if(F.col("dated")).alias("dated"),
        F.count_if(F.col("dated") & F.col("bot")).alias("bots"), F.count_if(F.col("dated") & ~F.col("bot")).alias("kept"),
    )


def length_classes(lines: DataFrame) -> DataFrame:
    """(long_enough, n)"""
    return lines.groupBy(parsing.long_enough(F.col("value")).alias("long_enough")).agg(F.count("*").alias("n"))


def character_counts(lines: DataFrame) -> DataFrame:
    """One row: lines, those of printable ASCII only, those that parse."""
    value = F.col("value")
    return lines.agg(F.count("*").alias("lines"), F.count_if(parsing.printable(value)).alias("printable"), F.count_if(parsing.well_formed(value)).alias("parsed"))
