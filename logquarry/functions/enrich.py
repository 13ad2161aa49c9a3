"""User-agent family, bot flag, country and flag columns."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BOT_ENDING, BOT_FAMILIES, BOT_WORDS, FAMILY_RULES, UNKNOWN_COUNTRY
from .parsing import ipv4_number, ipv6_groups


def _has(text: Column, how: str, parts: tuple[str, ...]) -> Column:
    tests = [text.startswith(p) if how == "start" else text.contains(p) for p in parts]
    return reduce(operator.and_ if how == "all" else operator.or_, tests)


def family(user_agent: Column) -> Column:
    out = F.when(user_agent == "", "Unknown")
    for name, how, parts in FAMILY_RULES:
        out = out.when(_has(user_agent, how, parts), name)
    return out.otherwise("Unknown")


_KNOWN = [name for name, _, _ in FAMILY_RULES] + ["Unknown"]
_KNOWN_BOTS = [n for n in _KNOWN if any(token in n.lower() for token in BOT_FAMILIES)]


def is_bot(user_agent: Column, family_name: Column) -> Column:
    """By the family (those of our own rules are settled beforehand) or the words of the agent; an empty agent is none."""
    low = F.lower(user_agent)
    listed = family_name.isin(_KNOWN_BOTS) | (~family_name.isin(_KNOWN) & F.lower(family_name).rlike("|".join(BOT_FAMILIES)))
    return (user_agent != "") & (listed | _has(low, "any", BOT_WORDS) | low.rlike(BOT_ENDING))


def address_key(ip: Column) -> Column:
    """An address as text that sorts as its number does: 4 and 8 hex digits, or 6 and 32; null for other text."""
    four = F.concat(F.lit("4"), F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0")))
    return F.coalesce(four, F.when(ip.contains(":"), F.concat(F.lit("6"), F.replace(ipv6_groups(ip), F.lit(":"), F.lit("")))))


def _block(key: Column) -> tuple[Column, Column]:
    """(kind, number) of the block of an address key: the first 16 bits of IPv4, the first 24 of IPv6."""
    kind = F.substring(key, 1, 1)
    return kind, F.conv(F.when(kind == "4", F.substring(key, 2, 4)).otherwise(F.substring(key, 2, 6)), 16, 10).cast("long")


def country_blocks(ranges: DataFrame) -> DataFrame:
    """ranges with their bounds as address keys, a row for each block they touch."""
    number = dict(ranges.dtypes)["first"] != "string"
    first, last = (F.concat(F.lit("4"), F.lower(F.lpad(F.hex(c), 8, "0"))) if number else address_key(F.col(c)) for c in ("first", "last"))
    keyed = ranges.select(first.alias("__first"), last.alias("__last"), F.col("country_code").alias("__code"), F.col("country_name").alias("__name"))
    (kind, low), (_, high) = _block(F.col("__first")), _block(F.col("__last"))
    return keyed.where("__first <= __last").withColumn("__kind", kind).withColumn("__number", F.explode(F.sequence(low, high)))


def with_country(df: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Adds country_code and country_name from ranges (first, last, country_code, country_name), last included.

    first and last are IPv4 numbers, or addresses of either kind as text; ranges do not overlap. A range join by blocks:
    each range is listed under the blocks it touches, so the join is an equi-join on the block with the bounds as a
    filter. The planner broadcasts the table if it is small. Join counts an address (`rollup.address_counts`) rather
    than hits where that will do.
    """
    keyed = df.withColumn("__key", address_key(F.col(ip)))
    kind, number = _block(F.col("__key"))
    blocks = country_blocks(ranges)
    hit = (kind == F.col("__kind")) & (number == F.col("__number")) & F.col("__key").between(F.col("__first"), F.col("__last"))
    code, name = UNKNOWN_COUNTRY
    out = keyed.join(blocks, hit, "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("country_code", "country_name")]
    return out.select(*kept, F.coalesce("__code", F.lit(code)).alias("country_code"), F.coalesce("__name", F.lit(name)).alias("country_name"))


def by_distinct(df: DataFrame, key: str, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds columns that are computed once for each distinct key and joined back.

    Worth it for dear functions of few distinct values; the planner broadcasts the distinct side if it is small.
    """
    found = df.select(key).distinct().select(key, *[f(F.col(key)).alias(n) for n, f in columns.items()])
    return df.join(found, df[key].eqNullSafe(found[key]), "left").drop(found[key])


def flag(code: Column) -> Column:
    """The flag of a two-letter code, else an empty text."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    flags = F.split(F.lit("".join(chr(0x1F1E6 + i) for i in range(26))), "")
    at = [F.instr(F.lit(letters), F.upper(F.substring(code, i, 1))) for i in (1, 2)]
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.concat(*[F.element_at(flags, a) for a in at])).otherwise("")
