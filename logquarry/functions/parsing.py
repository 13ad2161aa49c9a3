"""Column expressions over raw log lines and their fields (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FILE_EXTENSIONS, METHODS, MONTHS, PROTOCOLS

#: One pass over a line; the request must be printable ASCII with an HTTP/ protocol, the status three digits.
LINE_PATTERN = (
    r'(?s)^([^ ]*) [^ ]* [^ ]* \[([^\]]{3}(?:' + "|".join(MONTHS) + r')[^\]]{20,})\]."([!#-~]*) ([!#-~]*) (HTTP/[ !#-~]*)"'
    r'.([0-9]{3}).([^ ]*) "([^"]*)"."([^"]*)".*$'
)
FIELDS = ("ip", "time", "method", "path", "proto", "status", "bytes", "referer", "user_agent")
#: Cannot occur in a quoted field.
_SEPARATOR = '"\x01"'
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
V4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
V6_SHAPE = r"^[0-9a-f:]*$"
V6_BROKEN = r":::|::.*::|^:[^:]|[^:]:$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; a plain reuse would repeat its whole expression."""
    return F.get(F.transform(F.array(value), body), 0)


def long_enough(value: Column) -> Column:
    """At least 30 bytes with the newline: shorter lines cannot be well-formed."""
    return F.octet_length(value) + 1 >= 30


def printable(value: Column) -> Column:
    return value.rlike("^[ -~]*$")


def well_formed(value: Column) -> Column:
    return F.size(split_line(value)) == len(FIELDS)


def split_line(value: Column) -> Column:
    """The nine fields as an array; any other size means that the line is malformed."""
    marked = F.regexp_replace(value, F.lit(LINE_PATTERN), F.lit(_SEPARATOR.join(f"${i}" for i in range(1, len(FIELDS) + 1))))
    return F.split(marked, _SEPARATOR, -1)


def number_of_bytes(text: Column) -> Column:
    """Digits, else 0 (also beyond a long)."""
    return F.when(text.rlike("^[0-9]+$"), F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def dash_to_empty(text: Column) -> Column:
    return F.when(text.isin("-", ""), "").otherwise(text)


def strip_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def file_extension(path: Column) -> Column:
    """From the last dot of the last segment, else empty."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def referrer_host(url: Column) -> Column:
    """After the first :// up to / : or ?; null if there is none or it is empty."""
    host = F.substr(url, F.instr(url, "://") + F.lit(3))
    for end in "/:?":
        host = F.substring_index(host, end, 1)
    return F.when(url.contains("://"), F.nullif(host, F.lit("")))


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a number, leading zeros allowed; null otherwise."""
    number = F.aggregate(F.split(ip, r"\.", -1), F.lit(0).cast("bigint"), lambda n, octet: n * 256 + octet.cast("bigint"))
    return F.when(ip.rlike(V4_PATTERN), number)


def ipv4_text(number: Column) -> Column:
    """The canonical dotted quad of a number."""
    octet = [F.shiftrightunsigned(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octet)


def ipv6_groups(ip: Column) -> Column:
    """Eight four-digit groups joined by colons, or null; a dotted-quad tail is taken too."""

    def without_quad(low: Column) -> Column:
        tail = F.lpad(F.hex(ipv4_number(F.regexp_extract(low, r":([0-9.]+)$", 1))), 8, "0")
        pair = bound(F.lower(tail), lambda h: F.concat(F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(low.contains("."), F.regexp_replace(low, F.lit(r"[0-9]+\.[0-9.]+$"), pair)).otherwise(low)

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":", -1), lambda g: g != "")

    def filled(text: Column) -> Column:
        """The groups, with zeros in the place of the gap."""
        left, right = groups(F.substring_index(text, "::", 1)), groups(F.substr(text, F.instr(text, "::") + F.lit(2)))
        zeros = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
        return F.when(text.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), zeros), right)).otherwise(F.split(text, ":", -1))

    def key(full: Column) -> Column:
        good = (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ":"))

    def checked(text: Column) -> Column:
        return F.when(text.rlike(V6_SHAPE) & ~text.rlike(V6_BROKEN), bound(filled(text), key))

    return bound(bound(F.lower(ip), without_quad), checked)


def ip_key(ip: Column) -> Column:
    """Equal for equal addresses however they are spelt; other text stands for itself."""
    dotted = F.regexp_replace(ip, F.lit(r"(^|\.)0+(?=[0-9])"), F.lit("$1"))
    zeros = ip.startswith("0") | ip.contains(".0")  # few addresses need the rewriting
    return F.when(ip.rlike(V4_PATTERN), F.when(zeros, dotted).otherwise(ip)).when(ip.contains(":"), F.coalesce(ipv6_groups(ip), ip)).otherwise(ip)


def host_kind(key: Column) -> Column:
    """1: IPv4, 2: IPv6, 0: other text (of an ip_key)."""
    return F.when(key.rlike(V4_PATTERN), 1).when(key.rlike("^[0-9a-f]{4}(:[0-9a-f]{4}){7}$"), 2).otherwise(0)


def host_words(key: Column) -> tuple[Column, Column]:
    """(high, low) 64-bit words of an ip_key, 0 for text; conv gives unsigned text, the cast wraps through decimal."""
    digits = F.replace(key, F.lit(":"), F.lit(""))

    def word(at: int) -> Column:
        return F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint")

    kind = host_kind(key)
    return F.when(kind == 2, word(1)).otherwise(0).cast("bigint"), F.when(kind == 1, ipv4_number(key)).when(kind == 2, word(17)).otherwise(0).cast("bigint")


def iso_date(time: Column) -> Column:
    """YYYY-MM-DD of the wall clock as written."""
    month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    return F.concat_ws("-", F.substring(time, 8, 4), month[F.substring(time, 4, 3)], F.substring(time, 1, 2))


def wall_clock_ok(time: Column, date: Column) -> Column:
    """Digits where they belong, an existing day, hour below 24, minute and second below 60 and a signed offset."""
    shape = time.rlike(r"^[0-9]{2}/[A-Za-z]{3}/[0-9]{4}:([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] [+-][0-9]{4}")
    return F.coalesce(shape & date.try_cast("date").isNotNull(), F.lit(False))


def epoch(time: Column, date: Column) -> Column:
    """Seconds since 1970 in UTC of a time that wall_clock_ok() takes; date: its iso_date()."""

    def digits(at: int, n: int = 2) -> Column:
        return F.substring(time, at, n).try_cast("bigint")

    day = F.unix_date(date.try_cast("date")).cast("bigint")
    offset = (digits(23) * 60 + digits(25)) * 60
    local = day * 86400 + digits(13) * 3600 + digits(16) * 60 + digits(19)
    return local - F.when(F.substring(time, 22, 1) == "-", -offset).otherwise(offset)


def method_class(method: Column) -> Column:
    return F.when(method.isin(*METHODS), method).otherwise("other")


def protocol_class(proto: Column) -> Column:
    names = sorted(set(PROTOCOLS.values()))
    out = F
    for name in names:
        out = out.when(proto.isin(*[p for p, n in PROTOCOLS.items() if n == name]), name)
    return out.otherwise("other")


def status_class(status: Column) -> Column:
    """Anything below 400 that is not 2xx counts as 3xx, anything from 500 as 5xx."""
    return F.when((status >= 200) & (status < 300), "2xx").when(status < 400, "3xx").when(status < 500, "4xx").otherwise("5xx")


def content_kind(status: Column, path: Column) -> Column:
    """'file' or 'page' for a 2xx answer, else null; path without query."""
    kind = F.when(file_extension(path).isin(*FILE_EXTENSIONS), "file").otherwise("page")
    return F.when((status >= 200) & (status < 300), kind)


def is_weekend(date: Column) -> Column:
    """Saturday or Sunday of a date text; false for what is no date."""
    return F.coalesce(F.dayofweek(date.try_cast("date")).isin(1, 7), F.lit(False))
