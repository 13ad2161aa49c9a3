"""Raw access-log lines rendered from the test tables, once for Spark and once for DuckDB.

The same text template serves both engines; only dialect words differ. The lines carry every branch the
parser and the aggregates have: malformed lines, TLS bytes, odd sizes, offsets, methods and protocols,
referrers and self-referrers, bots and empty user agents, IPv4, IPv6 and plain-text visitors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"div": "div", "chr": "char", "stamp": "date_format({ts}, 'dd/MMM/yyyy:HH:mm:ss')", "plus": "timestampadd(SECOND, {s}, {ts})", "hex": "lower(hex({n}))"}
DUCKDB = {"div": "//", "chr": "chr", "stamp": "strftime({ts}, '%d/%b/%Y:%H:%M:%S')", "plus": "{ts} + to_seconds({s})", "hex": "format('{{:x}}', {n})"}

BASES = {
    "events": "SELECT event_id AS id, user_id AS uid, {ts_text} AS stamp, event_type AS kind, CAST(floor(abs(value) * 100) AS BIGINT) AS amount FROM events",
    "orders": "SELECT o_orderkey AS id, o_custkey AS uid, {ts_text} AS stamp, lower(o_orderstatus) AS kind, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders",
    "lineitem": "SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey * 7 + l_partkey % 7 AS uid, {ts_text} AS stamp, lower(l_returnflag) AS kind, CAST(floor(l_extendedprice) AS BIGINT) AS amount FROM lineitem",
}
_TIMES = {"events": ("ts", None), "orders": ("o_orderdate", "o_orderkey * 37 % 86400"), "lineitem": ("l_shipdate", "(l_orderkey * 8 + l_linenumber) * 37 % 86400")}

FIELDS = """
SELECT id, kind,
  CASE WHEN uid % 5 = 0 THEN '2001:DB8::' || {uid_hex} WHEN uid % 11 = 0 THEN 'host-' || CAST(uid AS STRING)
       WHEN uid % 13 = 0 THEN '010.' || CAST(uid % 200 AS STRING) || '.0.' || CAST(uid * 7 % 256 AS STRING)
       ELSE CAST(10 + uid % 6 AS STRING) || '.' || CAST(uid % 200 AS STRING) || '.' || CAST(uid {div} 256 % 256 AS STRING) || '.' || CAST(uid * 7 % 256 AS STRING) END AS ip,
  stamp || CASE WHEN id % 17 = 0 THEN ' +0100' WHEN id % 19 = 0 THEN ' -0230' ELSE ' +0000' END AS time,
  CASE WHEN id % 23 = 0 THEN 'HEAD' WHEN id % 29 = 0 THEN 'PURGE' WHEN id % 37 = 0 THEN 'PUT' WHEN kind IN ('purchase', 'signup', 'f') THEN 'POST' ELSE 'GET' END AS method,
  '/' || kind || '/p' || CAST(id % 40 AS STRING)
    || CASE id % 7 WHEN 0 THEN '.html' WHEN 1 THEN '.css' WHEN 2 THEN '.js' WHEN 3 THEN '' WHEN 4 THEN '.min.png' WHEN 5 THEN '.PNG' ELSE '/' END
    || CASE WHEN id % 4 = 0 THEN '?q=' || CAST(id AS STRING) ELSE '' END AS path,
  CASE id % 13 WHEN 0 THEN 'HTTP/1.0' WHEN 1 THEN 'HTTP/2.0' WHEN 2 THEN 'HTTP/2' WHEN 3 THEN 'HTTP/3.0' WHEN 4 THEN 'HTTP/9' ELSE 'HTTP/1.1' END AS proto,
  CASE WHEN id % 97 = 0 THEN '101' WHEN id % 89 = 0 THEN '999' WHEN kind = 'error' THEN '503' WHEN id % 10 = 1 THEN '302' WHEN id % 10 = 2 THEN '404' WHEN id % 10 = 3 THEN '304' WHEN id % 50 = 4 THEN '206' ELSE '200' END AS status,
  CASE WHEN id % 31 = 0 THEN '-' WHEN id % 33 = 0 THEN '12x' ELSE CAST(amount AS STRING) END AS bytes,
  CASE id % 6 WHEN 0 THEN '-' WHEN 1 THEN 'https://www.site.test/home' WHEN 2 THEN 'https://news.example.com:8443/item?id=' || CAST(id % 9 AS STRING)
       WHEN 3 THEN 'http://r' || CAST(uid % 30 AS STRING) || '.example.org?q=x' WHEN 4 THEN 'mailto:someone' ELSE 'https:///x://y' END AS referer,
  CASE WHEN id % 9 = 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' WHEN id % 14 = 1 THEN '-' WHEN id % 21 = 2 THEN 'curl/8.0'
       WHEN id % 22 = 3 THEN 'Mozilla/5.0 (compatible; SiteMonitor 1.0)'
       WHEN uid % 8 = 0 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0'
       WHEN uid % 8 = 1 THEN 'Mozilla/5.0 (Macintosh) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15'
       WHEN uid % 8 = 2 THEN 'Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36 Edg/120.0'
       WHEN uid % 8 = 3 THEN 'Opera/9.80 (Windows NT 6.1)' WHEN uid % 8 = 4 THEN 'Mozilla/4.0 (compatible; MSIE 8.0)' WHEN uid % 8 = 5 THEN 'SomethingElse/1'
       ELSE 'Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36' END AS user_agent
FROM base"""

LINES = """
SELECT id, CASE
  WHEN id % 41 = 0 THEN substr(ip || ' - frank [' || time, 1, 25)
  WHEN id % 43 = 0 THEN ip || ' - - [' || time || '] "' || {chr}(22) || {chr}(3) || '" 400 150 "-" "-"'
  WHEN id % 47 = 0 THEN ip || ' - - [' || time || '] "GET /caf' || {chr}(233) || ' HTTP/1.1" 200 5 "-" "-"'
  WHEN id % 53 = 0 THEN ip || ' - - [' || time || '] "GET /no-protocol" 200 5 "-" "-"'
  WHEN id % 59 = 0 THEN ip || ' - - [' || replace(time, '/', '-') || '] "GET / HTTP/1.1" 200 5 "-" "-"'
  WHEN id % 61 = 0 THEN ip || ' - - [31/Feb/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "-"'
  WHEN id % 67 = 0 THEN ip || ' - - [' || time || '] "GET /a b HTTP/1.1" 200 5 "-" "-"'
  ELSE ip || ' - frank [' || time || '] "' || method || ' ' || path || ' ' || proto || '" ' || status || ' ' || bytes || ' "' || referer || '" "' || user_agent || '"' END AS value
FROM fields"""


def _render(source: str, words: dict[str, str]) -> str:
    ts, seconds = _TIMES[source]
    moment = ts if seconds is None else words["plus"].format(ts=ts, s=seconds)
    text = f"base AS ({BASES[source]}), fields AS ({FIELDS}), lines AS ({LINES})"
    for k, v in {"ts_text": words["stamp"].format(ts=moment), "uid_hex": words["hex"].format(n="uid % 65536"), "div": words["div"], "chr": words["chr"]}.items():
        text = text.replace("{" + k + "}", v)
    return text


def lines(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    """(id, value): raw lines; id gives the arrival order."""
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet").repartition(spark.sparkContext.defaultParallelism)  # one small file each
    return spark.sql("WITH " + _render(source, SPARK).replace(f"FROM {source}", "FROM {t}", 1) + " SELECT id, value FROM lines", t=table)


def duckdb_lines(source: str = "events") -> str:
    """The CTEs base, fields and lines(id, value) for DuckDB."""
    return _render(source, DUCKDB).replace("AS STRING", "AS VARCHAR")
