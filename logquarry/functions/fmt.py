"""Report formatting as column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTH_NAMES, PALETTE, SHORT_STATUS_LABELS, STATUS_COLOURS, STATUS_LABELS, STATUS_ZERO, STATUS_ZERO_SHORT


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def compact(n: Column) -> Column:
    """Three significant figures with k, m, b or t; below 1000 as it is."""
    x = n.cast("double")
    units = ("", "k", "m", "b", "t")

    def places(v: Column) -> Column:
        return F.when(v >= 100, F.round(v, 0)).when(v >= 10, F.round(v, 1)).otherwise(F.round(v, 2))

    power = F.when(x < 1e6, 1).when(x < 1e9, 2).when(x < 1e12, 3).otherwise(4)
    scaled = F.when(x < 1e6, x / 1e3).when(x < 1e9, x / 1e3 / 1e3).when(x < 1e12, x / 1e3 / 1e3 / 1e3).otherwise(x / 1e3 / 1e3 / 1e3 / 1e3)
    carry = (places(scaled) >= 1000) & (power < 4)
    value = F.when(carry, places(places(scaled) / 1000)).otherwise(places(scaled))
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), F.when(carry, power + 2).otherwise(power + 1))
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), F.lit("0+$"), F.lit("")), F.lit(r"\.$"), F.lit(""))
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(number, unit))


def byte_size(n: Column) -> Column:
    """1024-based: B whole, KB and MB with one decimal, GB, TB and PB with two; ties to even."""
    x = n.cast("double")
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit, decimals in ((1, "KB", 1), (2, "MB", 1), (3, "GB", 2), (4, "TB", 2)):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.format_string(f"%.{decimals}f", F.bround(x / 1024**power, decimals)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.2f", F.bround(x / 1024**5, 2)), F.lit(" PB")))


def percent(value: Column, total: Column) -> Column:
    """One decimal; 0 if the total is not positive."""
    return F.when(total > 0, F.round(value.cast("double") / total * 1000) / 10).otherwise(0.0)


def percent_text(value: Column, total: Column) -> Column:
    return F.concat(F.format_string("%.1f", percent(value, total)), F.lit("%"))


def _labels(status: Column, labels: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)]), status.cast("int"))


def status_label(status: Column) -> Column:
    code = F.concat(F.lit("Code "), status.cast("string"))
    return F.when(status == 0, STATUS_ZERO).otherwise(F.concat_ws(" - ", code, _labels(status, STATUS_LABELS)))


def short_status_label(status: Column) -> Column:
    return F.when(status == 0, STATUS_ZERO_SHORT).otherwise(F.coalesce(_labels(status, SHORT_STATUS_LABELS), status.cast("string")))


def month_name(month: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.greatest(month - 1, F.lit(0)).cast("int")), F.lit("Unknown"))


def month_short(month: Column) -> Column:
    return F.substring(month_name(month), 1, 3)


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def day_label(date: Column) -> Column:
    return F.substring_index(date, "-", -1)


def megabytes(n: Column) -> Column:
    return F.round(n.cast("double") / 1048576 * 100) / 100


def palette(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (index % len(PALETTE) + 1).cast("int"))


def status_colour(status: Column, index: Column) -> Column:
    out = F
    for hundred, colour in STATUS_COLOURS.items():
        out = out.when((status >= hundred * 100) & (status < hundred * 100 + 100), colour)
    return out.otherwise(palette(index))


def use_compact(precision: int) -> bool:
    """Whether an estimate of this sketch precision is shown with three figures only."""
    return 1.04 / 2 ** (precision / 2) > 0.001


def estimate_text(n: Column, precision: int) -> Column:
    """An estimated count as pages show it: three figures where the sketch is not exact enough for more."""
    return compact(n) if use_compact(precision) else thousands(n)


def byte_text(n: int) -> str:
    """byte_size() of one number."""
    units = ((1, "KB", 1), (2, "MB", 1), (3, "GB", 2), (4, "TB", 2), (5, "PB", 2))
    if n < 1024:
        return f"{n} B"
    power, unit, digits = next((u for u in units if n < 1024 ** (u[0] + 1)), units[-1])
    return f"{n / 1024**power:.{digits}f} {unit}"


def compact_text(n: int) -> str:
    """compact() of one number."""
    if n < 1000:
        return str(n)
    value, unit = float(n), 0
    while value >= 1000 and unit < 4:
        value, unit = value / 1000, unit + 1
    for _ in range(2):
        digits = 0 if value >= 100 else 1 if value >= 10 else 2
        value = float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
        if value < 1000 or unit == 4:
            break
        value, unit = value / 1000, unit + 1
    return f"{value:.2f}".rstrip("0").rstrip(".") + ("", "k", "m", "b", "t")[unit]
