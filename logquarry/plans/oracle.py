"""DuckDB text of the shared steps: lines, records and hits.

Written apart from the operators: lines are taken apart by positions and splits instead of a pattern, and agents,
methods, protocols and extensions are classified by what is expected of each value that the rendered lines have.
"""

from __future__ import annotations

from ..schema import MONTHS
from .adapters import duckdb_lines

#: Country ranges of the test queries.
GEO = [
    ("10.0.0.0", "10.99.255.255", "DE", "Germany"),
    ("10.100.0.0", "10.180.3.7", "FR", "France"),
    ("11.0.0.0", "11.255.255.255", "US", "United States"),
    ("12.0.0.0", "12.63.255.255", "JP", "Japan"),
    ("13.17.0.0", "13.190.255.255", "BR", "Brazil"),
    ("2001:db8::", "2001:db8::1fff", "NL", "Netherlands"),
    ("2001:db8:0:0::6000", "2001:DB8::ffff", "SE", "Sweden"),
]


def number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def literals(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


GEO_CTE = "geo(first, last, code, name) AS (VALUES " + ", ".join(f"({number(a)}, {number(b)}, '{c}', '{n}')" for a, b, c, n in GEO if ":" not in a) + ")"
GEO6_CTE = """geo6(first, last, code, name) AS (VALUES
  ('2001:0db8:0000:0000:0000:0000:0000:0000', '2001:0db8:0000:0000:0000:0000:0000:1fff', 'NL', 'Netherlands'),
  ('2001:0db8:0000:0000:0000:0000:0000:6000', '2001:0db8:0000:0000:0000:0000:0000:ffff', 'SE', 'Sweden'))"""

V4 = r"regexp_full_match({ip}, '[0-9]{1,9}(\.[0-9]{1,9}){3}') AND list_max([TRY_CAST(x AS BIGINT) FOR x IN string_split({ip}, '.')]) <= 255"
V4_NUMBER = "CASE WHEN " + V4 + " THEN TRY_CAST(split_part({ip}, '.', 1) AS BIGINT) * 16777216 + TRY_CAST(split_part({ip}, '.', 2) AS BIGINT) * 65536 + TRY_CAST(split_part({ip}, '.', 3) AS BIGINT) * 256 + TRY_CAST(split_part({ip}, '.', 4) AS BIGINT) END"


def v4_number(ip: str) -> str:
    return V4_NUMBER.replace("{ip}", ip)


def v6_key(ip: str) -> str:
    """Only for valid addresses with a gap."""
    left = f"[x FOR x IN string_split(split_part(lower({ip}), '::', 1), ':') IF x <> '']"
    right = f"[x FOR x IN string_split(split_part(lower({ip}), '::', 2), ':') IF x <> '']"
    return f"array_to_string([lpad(g, 4, '0') FOR g IN list_concat({left}, [CAST(0 AS VARCHAR) FOR i IN range(8 - len({left}) - len({right}))], {right})], ':')"


def ip_key(ip: str) -> str:
    dotted = f"array_to_string([CAST(TRY_CAST(x AS BIGINT) AS VARCHAR) FOR x IN string_split({ip}, '.')], '.')"
    return f"CASE WHEN {V4.replace('{ip}', ip)} THEN {dotted} WHEN contains({ip}, '::') THEN {v6_key(ip)} ELSE {ip} END"


MONTH_NUMBER = f"lpad(CAST((instr('{''.join(MONTHS)}', substr(time, 4, 3)) + 2) // 3 AS VARCHAR), 2, '0')"
DATE = f"substr(time, 8, 4) || '-' || {MONTH_NUMBER} || '-' || substr(time, 1, 2)"
CLOCK_OK = r"regexp_matches(time, '^[0-9]{2}/[A-Za-z]{3}/[0-9]{4}:([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] [+-][0-9]{4}') AND try_cast(" + DATE + " AS DATE) IS NOT NULL"
EPOCH = "CAST(epoch(try_strptime(substr(time, 1, 20), '%d/%b/%Y:%H:%M:%S')) AS BIGINT) - CASE substr(time, 22, 1) WHEN '-' THEN -1 ELSE 1 END * (CAST(substr(time, 23, 2) AS BIGINT) * 3600 + CAST(substr(time, 25, 2) AS BIGINT) * 60)"
EXT = r"regexp_extract({p}, '(\.[^./]*)$', 1)"


#: The agents of the rendered lines: start of the text, family, whether a bot.
AGENTS = (
    ("Mozilla/5.0 (compatible; Googlebot", "Googlebot", True), ("curl/8.0", "curl", True), ("Mozilla/5.0 (compatible; SiteMonitor", "Unknown", True),
    ("Mozilla/5.0 (X11;", "Firefox", False), ("Mozilla/5.0 (Macintosh)", "Safari", False), ("Opera/9.80", "Opera", False), ("Mozilla/4.0", "Internet Explorer", False), ("SomethingElse/1", "Unknown", False),
)
_WINDOWS = "WHEN starts_with(user_agent, 'Mozilla/5.0 (Windows') THEN CASE WHEN ends_with(user_agent, 'Edg/120.0') THEN 'Edge' ELSE 'Chrome' END"
FAMILY = "CASE WHEN user_agent = '' THEN 'Unknown' " + " ".join(f"WHEN starts_with(user_agent, '{t}') THEN '{n}'" for t, n, _ in AGENTS) + f" {_WINDOWS} END"
IS_BOT = "(" + " OR ".join(f"starts_with(user_agent, '{t}')" for t, _, bot in AGENTS if bot) + ")"
METHOD = "CASE method WHEN 'PURGE' THEN 'other' ELSE method END"
PROTO = "CASE proto WHEN 'HTTP/1.0' THEN '1.0' WHEN 'HTTP/1.1' THEN '1.1' WHEN 'HTTP/2' THEN '2.0' WHEN 'HTTP/2.0' THEN '2.0' WHEN 'HTTP/3.0' THEN '3.0' ELSE 'other' END"
STATUS_CLASS = "CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status < 400 THEN '3xx' WHEN status < 500 THEN '4xx' ELSE '5xx' END"


def ref_host(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN nullif(regexp_extract(substr({url}, instr({url}, '://') + 3), '^([^/:?]+)', 1), '') END"


def content(path: str) -> str:
    return f"CASE WHEN status BETWEEN 200 AND 299 THEN CASE WHEN {EXT.replace('{p}', path)} IN ('.css', '.js', '.png') THEN 'file' ELSE 'page' END END"


RECORDS = f"""
heads AS (SELECT id, value, string_split(value, ' ') AS w FROM lines),
bracketed AS (SELECT id, w[1] AS ip, substr(value, length(w[1]) + length(w[2]) + length(w[3]) + 5) AS after FROM heads WHERE len(w) > 3 AND starts_with(w[4], '[') AND contains(value, ']')),
timed AS (SELECT id, ip, split_part(after, ']', 1) AS time, substr(after, instr(after, ']') + 1) AS rest FROM bracketed WHERE contains(after, ']')),
requested AS (SELECT *, split_part(substr(rest, 3), '"', 1) AS request FROM timed WHERE length(time) >= 26 AND substr(time, 4, 3) IN ({literals(MONTHS)}) AND substr(rest, 2, 1) = '"'),
split AS (SELECT id, ip, time, split_part(request, ' ', 1) AS method, split_part(request, ' ', 2) AS path, substr(request, length(split_part(request, ' ', 1)) + length(split_part(request, ' ', 2)) + 3) AS proto, substr(rest, length(request) + 3) AS tail
  FROM requested WHERE list_bool_and([ascii(c) BETWEEN 32 AND 126 FOR c IN string_split(request, '')])),
numbered_tail AS (SELECT *, substr(tail, 3, 3) AS code, split_part(substr(tail, 7), ' ', 1) AS size, substr(tail, 7 + length(split_part(substr(tail, 7), ' ', 1))) AS quoted FROM split WHERE starts_with(proto, 'HTTP/') AND starts_with(tail, '"')),
referred AS (SELECT *, split_part(substr(quoted, 3), '"', 1) AS referer_text, substr(quoted, length(split_part(substr(quoted, 3), '"', 1)) + 3) AS last FROM numbered_tail WHERE starts_with(quoted, ' "') AND length(code) = 3 AND translate(code, '0123456789', '') = ''),
records AS (SELECT id, ip, time, method, path, proto, CAST(code AS INTEGER) AS status, CASE WHEN size <> '' AND translate(size, '0123456789', '') = '' THEN coalesce(try_cast(size AS BIGINT), 0) ELSE 0 END AS bytes,
  CASE WHEN referer_text = '-' THEN '' ELSE referer_text END AS referer, CASE WHEN agent = '-' THEN '' ELSE agent END AS user_agent
  FROM (SELECT *, split_part(substr(last, 4), '"', 1) AS agent FROM referred WHERE starts_with(last, '"') AND substr(last, 3, 1) = '"' AND contains(substr(last, 4), '"')))"""

HITS = f"""
all_hits AS (SELECT id, {ip_key('ip')} AS ip, {EPOCH} AS ts, {DATE} AS date, CAST(substr(time, 13, 2) AS INTEGER) AS hour, split_part(path, '?', 1) AS url,
  {METHOD} AS method, {PROTO} AS proto, status, {STATUS_CLASS} AS status_class, {content("split_part(path, '?', 1)")} AS content, bytes,
  {ref_host('referer')} AS ref_host, {FAMILY} AS family, substr({DATE}, 1, 7) AS month, substr({DATE}, 1, 4) AS year, {IS_BOT} AS is_bot
  FROM records WHERE {CLOCK_OK}),
hits AS (SELECT * FROM all_hits WHERE NOT is_bot),
visited AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY ip ORDER BY ts, id) > 1800, TRUE) AS new_visit FROM hits),
hourly AS (SELECT date, hour, count(*) AS hits, CAST(sum(CAST(new_visit AS INT)) AS BIGINT) AS visits, count(*) FILTER (content = 'file') AS files, count(*) FILTER (content = 'page') AS pages,
  CAST(sum(bytes) AS BIGINT) AS bandwidth, count(*) FILTER (status_class = '2xx') AS status_2xx, count(*) FILTER (status_class = '3xx') AS status_3xx,
  count(*) FILTER (status_class = '4xx') AS status_4xx, count(*) FILTER (status_class = '5xx') AS status_5xx, count(DISTINCT ip) AS sites FROM visited GROUP BY date, hour)"""

LOCATED = f"""{GEO_CTE}, {GEO6_CTE}, numbered AS (SELECT *, {v4_number('ip')} AS n FROM hits),
located AS (SELECT h.*, coalesce(g.code, s.code, '--') AS country_code, coalesce(g.name, s.name, 'Unknown') AS country_name
  FROM numbered h LEFT JOIN geo g ON h.n BETWEEN g.first AND g.last LEFT JOIN geo6 s ON contains(h.ip, ':') AND h.ip BETWEEN s.first AND s.last)"""


def periods(keys: str, table: str = "hits", sums: str = "", where: str = "TRUE") -> str:
    """SELECT of (grain, period, keys, hits, sums) for months and years."""
    one = "SELECT '{g}' AS grain, {g} AS period, " + keys + ", count(*) AS hits" + sums + " FROM " + table + " WHERE " + where + " GROUP BY ALL"
    return one.replace("{g}", "month") + " UNION ALL " + one.replace("{g}", "year")


def with_lines(tail: str, source: str = "events") -> str:
    return f"WITH {duckdb_lines(source)} {tail}"


def with_records(tail: str, source: str = "events") -> str:
    return f"WITH {duckdb_lines(source)}, {RECORDS} {tail}"


def with_hits(tail: str, source: str = "events", *more: str) -> str:
    return f"WITH {duckdb_lines(source)}, {RECORDS}, {HITS}" + "".join(f", {m}" for m in more) + f" {tail}"
