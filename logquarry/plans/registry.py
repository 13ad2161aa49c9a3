"""All log-analytics queries by name, with their DuckDB text.

Each query renders raw lines from a test table and runs the real operators over them; its SQL does the same from
the same lines. Names start with the operator's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enrich, fmt, parsing
from ..operators import hits as H
from ..operators import reports, rollup, sketch, topk, upsert, visits
from ..schema import MONTH_NAMES, PALETTE, SHORT_STATUS_LABELS, STATUS_LABELS, STATUS_ZERO, STATUS_ZERO_SHORT
from . import adapters
from . import oracle as O

SITE = "www.site.test"
MONTH, YEAR = "1997-03", "1997"
TOP = 20

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Shared inputs


def records(s: SparkSession, d: str, source: str = "events") -> DataFrame:
    return H.parse_lines(adapters.lines(s, d, source))


def hits(s: SparkSession, d: str, source: str = "orders") -> DataFrame:
    return H.hits(adapters.lines(s, d, source))


def geo(s: SparkSession) -> DataFrame:
    return s.createDataFrame(O.GEO, "first string, last string, country_code string, country_name string")


def located(s: SparkSession, d: str, source: str = "orders") -> DataFrame:
    return enrich.with_country(hits(s, d, source), geo(s))


def addresses(s: SparkSession, d: str, source: str = "orders") -> DataFrame:
    return enrich.with_country(rollup.address_counts(hits(s, d, source)), geo(s))


def hourly(s: SparkSession, d: str, source: str = "orders") -> DataFrame:
    return rollup.hourly_of(hits(s, d, source))


# Parsing

query("p01_parse_line", O.with_records("SELECT * FROM records"))(lambda s, d: records(s, d))
query("p02_min_length", O.with_records("SELECT octet_length(encode(value)) >= 29 AS long_enough, count(*) AS n FROM lines GROUP BY 1"))(lambda s, d: H.length_classes(adapters.lines(s, d)))
query("p03_timestamp", O.with_records("SELECT substr(time, 4, 3) AS month, length(time) AS n_chars, count(*) AS n FROM records GROUP BY ALL"))(lambda s, d: records(s, d).groupBy(F.substring("time", 4, 3).alias("month"), F.length("time").cast("long").alias("n_chars")).agg(F.count("*").alias("n")))
query("p04_ascii_filter", O.with_records("SELECT count(*) AS lines, count(*) FILTER (regexp_matches(value, '^[ -~]*$')) AS printable, (SELECT count(*) FROM records) AS parsed FROM lines"))(
    lambda s, d: H.character_counts(adapters.lines(s, d))
)
query("p05_status", O.with_records("SELECT status, count(*) AS n FROM records GROUP BY 1"))(lambda s, d: records(s, d).groupBy("status").agg(F.count("*").alias("n")))
query("p06_bytes_default", O.with_records("SELECT id, status, bytes FROM records"))(lambda s, d: records(s, d).select("id", "status", "bytes"))
query("p07_request_split", O.with_records("SELECT id, method, path, proto FROM records"))(lambda s, d: records(s, d).select("id", "method", "path", "proto"))
query("p08_protocol_filter", O.with_records("SELECT proto, count(*) AS n FROM records GROUP BY 1"))(lambda s, d: records(s, d).groupBy("proto").agg(F.count("*").alias("n")))
query("p09_dash", O.with_records("SELECT id, referer, user_agent FROM records WHERE referer = '' OR user_agent = ''"))(lambda s, d: records(s, d).where("referer = '' OR user_agent = ''").select("id", "referer", "user_agent"))
query("p10_strip_query", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", parsing.strip_query(F.col("url")).alias("url")))
query("p11_file_ext", "SELECT page_id, " + O.EXT.replace("{p}", "split_part(url, '?', 1)") + " AS ext FROM pages")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", parsing.file_extension(parsing.strip_query(F.col("url"))).alias("ext"))
)
query("p12_ref_host", "SELECT page_id, " + O.ref_host("url") + " AS host FROM pages")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", parsing.referrer_host(F.col("url")).alias("host")))
query("p13_ipv4", O.with_records(f"SELECT DISTINCT ip, {O.v4_number('ip')} AS number FROM records"))(lambda s, d: records(s, d).select("ip").distinct().select("ip", parsing.ipv4_number(F.col("ip")).alias("number")))
query("p14_ipv6", O.with_records(f"SELECT DISTINCT ip, {O.v6_key('ip')} AS key FROM records WHERE contains(ip, '::')"))(lambda s, d: records(s, d).select("ip").distinct().where(F.col("ip").contains("::")).select("ip", parsing.ipv6_groups(F.col("ip")).alias("key")))


@query("p15_host_key", O.with_records(f"SELECT DISTINCT key, CASE WHEN {O.V4.replace('{ip}', 'key')} THEN 1 WHEN contains(key, ':') THEN 2 ELSE 0 END AS kind, coalesce({O.v4_number('key')}, CASE WHEN contains(key, ':') THEN CAST('0x' || right(replace(key, ':', ''), 16) AS BIGINT) ELSE 0 END) AS low FROM (SELECT {O.ip_key('ip')} AS key FROM records)"))
def p15_host_key(s, d):
    keys = records(s, d).select(parsing.ip_key(F.col("ip")).alias("key")).distinct()
    return keys.select("key", parsing.host_kind(F.col("key")).alias("kind"), parsing.host_words(F.col("key"))[1].alias("low"))


query("p16_periods", O.with_hits("SELECT id, date, month, year, hour FROM all_hits"))(lambda s, d: H.to_hits(records(s, d)).select("id", "date", "month", "year", "hour"))
query("p17_epoch", O.with_hits("SELECT id, ts FROM all_hits"))(lambda s, d: H.to_hits(records(s, d)).select("id", "ts"))
query("p18_method", O.with_records(f"SELECT id, {O.METHOD} AS method FROM records"))(lambda s, d: records(s, d).select("id", parsing.method_class(F.col("method")).alias("method")))
query("p19_proto", O.with_records(f"SELECT id, {O.PROTO} AS proto FROM records"))(lambda s, d: records(s, d).select("id", parsing.protocol_class(F.col("proto")).alias("proto")))
query("p20_status_class", O.with_records(f"SELECT status, {O.STATUS_CLASS} AS class, count(*) AS n FROM records GROUP BY ALL"))(lambda s, d: records(s, d).groupBy("status", parsing.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n")))
query("p21_file_or_page", O.with_records("SELECT content, count(*) AS n FROM (SELECT " + O.content("split_part(path, '?', 1)") + " AS content FROM records) GROUP BY ALL"))(
    lambda s, d: records(s, d).groupBy(parsing.content_kind(F.col("status"), parsing.strip_query(F.col("path"))).alias("content")).agg(F.count("*").alias("n"))
)
query("p22_weekend", O.with_hits("SELECT DISTINCT date, dayofweek(CAST(date AS DATE)) IN (0, 6) AS weekend FROM all_hits", "orders"))(lambda s, d: H.to_hits(records(s, d, "orders")).select("date").distinct().select("date", parsing.is_weekend(F.col("date")).alias("weekend")))

# Filters and enrichment

query("f01_bot_filter", O.with_hits("SELECT id, ip, url FROM hits"))(lambda s, d: hits(s, d, "events").select("id", "ip", "url"))
query("f02_self_ref", O.with_hits(O.periods("ref_host", where=f"ref_host IS NOT NULL AND ref_host <> '{SITE}'"), "orders"))(lambda s, d: rollup.referrer_counts(hits(s, d), SITE))
query("f04_prefix", O.with_hits(f"SELECT * FROM hourly WHERE date LIKE '{MONTH}-%'", "orders"))(lambda s, d: reports.in_period(hourly(s, d), MONTH))
query("f05_grain", O.with_hits(f"SELECT * FROM ({O.periods('method')}) WHERE length(period) = 4", "orders"))(lambda s, d: topk.of_grain(rollup.method_counts(hits(s, d)), "year"))
query("f06_not_latest", O.with_hits(f"SELECT * FROM ({O.periods('method')}) m WHERE period < (SELECT max(period) FROM ({O.periods('method')}) x WHERE length(x.period) = length(m.period))", "orders"))(lambda s, d: topk.not_latest(rollup.method_counts(hits(s, d))))
query("f07_counts", O.with_hits("SELECT (SELECT count(*) FROM lines) AS lines, (SELECT count(*) FROM records) AS parsed, count(*) AS dated, count(*) FILTER (is_bot) AS bots, count(*) FILTER (NOT is_bot) AS kept FROM all_hits"))(lambda s, d: H.line_counts(adapters.lines(s, d)))
query("e01_ua_family", O.with_records(f"SELECT DISTINCT user_agent, {O.FAMILY} AS family FROM records"))(lambda s, d: records(s, d).select("user_agent").distinct().select("user_agent", enrich.family(F.col("user_agent")).alias("family")))
query("e02_bot", O.with_records(f"SELECT DISTINCT user_agent, {O.IS_BOT} AS bot FROM records"))(lambda s, d: records(s, d).select("user_agent").distinct().select("user_agent", enrich.is_bot(F.col("user_agent"), enrich.family(F.col("user_agent"))).alias("bot")))
query("e03_geo_range", O.with_hits("SELECT id, ip, country_code, country_name FROM located", "events", O.LOCATED))(lambda s, d: located(s, d, "events").select("id", "ip", "country_code", "country_name"))
query("e04_distinct_enrich", O.with_records(f"SELECT id, {O.FAMILY} AS family FROM records"))(lambda s, d: enrich.by_distinct(records(s, d).select("id", "user_agent"), "user_agent", {"family": enrich.family}).select("id", "family"))
query("e05_country_dim", O.with_hits("SELECT country_code, coalesce(min(nullif(country_name, 'Unknown')), 'Unknown') AS country_name FROM located GROUP BY 1", "events", O.LOCATED))(lambda s, d: rollup.country_names(enrich.with_country(rollup.distinct_hosts(hits(s, d, "events")), geo(s))))
query("e06_flag", "SELECT n_name, CASE WHEN regexp_matches(left(n_name, 2), '^[A-Za-z]{2}$') THEN chr(127397 + ascii(upper(n_name[1]))) || chr(127397 + ascii(upper(n_name[2]))) ELSE '' END AS flag FROM nation")(
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_name", enrich.flag(F.substring("n_name", 1, 2)).alias("flag"))
)

# Joins

HOSTS = "SELECT '{g}' AS grain, {g} AS period, ip, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bandwidth, coalesce(max(nullif(country_code, '--')), '--') AS country_code FROM located GROUP BY ALL"
HOSTS = HOSTS.replace("{g}", "month") + " UNION ALL " + HOSTS.replace("{g}", "year")
NAMES = "SELECT country_code, coalesce(min(nullif(country_name, 'Unknown')), 'Unknown') AS country_name FROM located GROUP BY 1"


def hosts(s, d):
    return rollup.host_counts(addresses(s, d))


def names(s, d):
    return rollup.country_names(addresses(s, d))


query("j01_hosts_country", O.with_hits(f"SELECT grain, period, ip, hits, bandwidth, coalesce(h.country_code, '--') AS country_code, coalesce(country_name, 'Unknown') AS country_name FROM ({HOSTS}) h LEFT JOIN ({NAMES}) n USING (country_code)", "orders", O.LOCATED))(
    lambda s, d: reports.with_country_name(hosts(s, d), names(s, d)).select("grain", "period", "ip", "hits", "bandwidth", "country_code", "country_name")
)
query("j02_countries_name", O.with_hits(f"SELECT grain, period, country_code, hits, coalesce(country_name, 'Unknown') AS country_name FROM ({O.periods('country_code', 'located')}) c LEFT JOIN ({NAMES}) n USING (country_code)", "orders", O.LOCATED))(
    lambda s, d: reports.with_country_name(rollup.country_counts(addresses(s, d)), names(s, d))
)
query("j03_agg_then_join", O.with_hits(f"SELECT country_code, hits, coalesce(country_name, 'Unknown') AS country_name FROM (SELECT country_code, count(*) AS hits FROM located GROUP BY 1) c LEFT JOIN ({NAMES}) n USING (country_code)", "orders", O.LOCATED))(
    lambda s, d: reports.with_country_name(reports.all_time(rollup.country_counts(addresses(s, d)), "country_code"), names(s, d))
)
query("j04_sites_lookup", O.with_hits("SELECT m.*, s.sites FROM (SELECT month, count(*) AS hits FROM hits GROUP BY 1) m LEFT JOIN (SELECT month, count(DISTINCT ip) AS sites FROM hits GROUP BY 1) s USING (month)", "orders"))(
    lambda s, d: reports.with_sites(hits(s, d).groupBy("month").agg(F.count("*").alias("hits")), rollup.distinct_sites(hits(s, d)), "month")
)
query("j05_range_join", O.with_hits("SELECT DISTINCT ip, country_code FROM located", "orders", O.LOCATED))(lambda s, d: enrich.with_country(rollup.distinct_hosts(hits(s, d)), geo(s)).select("ip", "country_code"))
SPLIT = 1704931200


O_LAST_SEEN = f"SELECT id, ip, ts, coalesce(ts - coalesce(lag(ts) OVER (PARTITION BY ip ORDER BY ts, id), last_seen) > 1800, TRUE) AS new_visit FROM (SELECT * FROM hits WHERE ts >= {SPLIT}) LEFT JOIN (SELECT ip, max(ts) AS last_seen FROM hits WHERE ts < {SPLIT} GROUP BY 1) USING (ip)"


@query("j06_last_seen", O.with_hits(O_LAST_SEEN))
def j06_last_seen(s, d):
    h = hits(s, d, "events")
    state = visits.visit_state(h.where(F.col("ts") < SPLIT))
    return visits.mark_visits(h.where(F.col("ts") >= SPLIT), state).select("id", "ip", "ts", "new_visit")


query("j06_last_seen_split", _sql["j06_last_seen"])(
    lambda s, d: visits.mark_visits(hits(s, d, "events").where(F.col("ts") >= SPLIT), visits.visit_state(hits(s, d, "events").where(F.col("ts") < SPLIT)), 600).select("id", "ip", "ts", "new_visit")
)
query("j06_hourly_state", O.with_hits(f"SELECT date, hour, count(*) AS hits, CAST(sum(CAST(new_visit AS INT)) AS BIGINT) AS visits FROM ({O_LAST_SEEN.replace('id, ip, ts,', '*,')}) GROUP BY ALL"))(
    lambda s, d: rollup.hourly_of(hits(s, d, "events").where(F.col("ts") >= SPLIT), visits.visit_state(hits(s, d, "events").where(F.col("ts") < SPLIT))).select("date", "hour", "hits", "visits")
)
query("j07_anti_processed", O.with_hits(f"SELECT DISTINCT ip FROM hits WHERE ts >= {SPLIT} AND ip NOT IN (SELECT ip FROM hits WHERE ts < {SPLIT})"))(
    lambda s, d: upsert.insert_ignore(hits(s, d, "events").where(F.col("ts") < SPLIT).select("ip").distinct(), hits(s, d, "events").where(F.col("ts") >= SPLIT).select("ip"), ["ip"])
)

# Rollups

query("a01_hourly", O.with_hits("SELECT * FROM hourly"))(lambda s, d: hourly(s, d, "events"))
query("a02_hourly_sites", O.with_hits("SELECT date, hour, count(DISTINCT ip) AS sites FROM hits GROUP BY ALL", "lineitem"))(lambda s, d: hourly(s, d, "lineitem").select("date", "hour", "sites"))
GRAINS = "SELECT 'day' AS grain, date AS period, {x} FROM hits GROUP BY ALL UNION ALL SELECT 'month', month, {x} FROM hits GROUP BY ALL UNION ALL SELECT 'year', year, {x} FROM hits GROUP BY ALL UNION ALL SELECT 'all', '__all__', {x} FROM hits"
query("a03_grains", O.with_hits(GRAINS.replace("{x}", "count(DISTINCT ip) AS sites"), "orders"))(lambda s, d: rollup.distinct_sites(hits(s, d)))
BW = ", CAST(sum(bytes) AS BIGINT) AS bandwidth"
query("a04_urls", O.with_hits(O.periods("url", sums=BW), "orders"))(lambda s, d: rollup.url_counts(hits(s, d)))
query("a05_hosts", O.with_hits(HOSTS, "orders", O.LOCATED))(hosts)
query("a06_refs", O.with_hits(O.periods("ref_host", where="ref_host IS NOT NULL"), "orders"))(lambda s, d: rollup.referrer_counts(hits(s, d)))
query("a07_agents", O.with_hits(O.periods("family"), "orders"))(lambda s, d: rollup.agent_counts(hits(s, d)))
query("a08_countries", O.with_hits(O.periods("country_code", "located"), "orders", O.LOCATED))(lambda s, d: rollup.country_counts(addresses(s, d)))
query("a09_status", O.with_hits(O.periods("status"), "orders"))(lambda s, d: rollup.status_counts(hits(s, d)))
query("a10_method", O.with_hits(O.periods("method"), "orders"))(lambda s, d: rollup.method_counts(hits(s, d)))
query("a11_proto", O.with_hits(O.periods("proto"), "orders"))(lambda s, d: rollup.protocol_counts(hits(s, d)))


def _bound(exact: DataFrame, estimated: DataFrame) -> DataFrame:
    """Whether each estimate is within five standard errors (or 2) of the exact count."""
    error = F.abs(F.col("sites") - F.col("exact"))
    room = F.greatest(F.lit(2.0), F.col("exact") * (5 * 1.04 / 2**7))
    return exact.withColumnRenamed("sites", "exact").join(estimated.select("grain", "period", "sites"), ["grain", "period"]).select("grain", "period", (error <= room).alias("within"))


WITHIN = O.with_hits(f"SELECT grain, period, TRUE AS within FROM ({GRAINS.replace('{x}', '1 AS x')}) GROUP BY ALL", "orders")


@query("a12_hll_bound", WITHIN)
def a12_hll_bound(s, d):
    """Sketches of the days' distinct visitors, so that both sides share one exchange of one parse."""
    days = rollup.daily_visitors(hits(s, d))
    return _bound(rollup.distinct_sites(days), sketch.estimates(sketch.scope_sketches(sketch.day_sketches(days))))


@query("a14_scopes_from_days", O.with_hits(f"SELECT grain, period, TRUE AS within FROM ({GRAINS.replace('{x}', '1 AS x')}) WHERE grain IN ('month', 'year') GROUP BY ALL", "orders"))
def a14_scopes_from_days(s, d):
    """Months and years from the day sketches alone, no hit read again."""
    days = rollup.daily_visitors(hits(s, d))
    scopes = sketch.estimates(sketch.scope_sketches(sketch.day_sketches(days))).where("grain IN ('month', 'year')")
    return _bound(rollup.distinct_sites(days), scopes)


@query("m03_sketch_merge", O.with_hits(f"SELECT grain, period, TRUE AS same FROM ({GRAINS.replace('{x}', '1 AS x')}) GROUP BY ALL", "orders"))
def m03_sketch_merge(s, d):
    """Merging is idempotent and takes parts in any order."""
    days = rollup.daily_visitors(hits(s, d))
    parts = [sketch.scope_sketches(sketch.day_sketches(days.where(F.col("date").endswith(str(k)) == (k == 1)) if k < 2 else days)) for k in (1, 2)]
    one, two = sketch.merge_sketches(parts[0], parts[1]), sketch.merge_sketches(parts[1], parts[0], parts[1])
    both = sketch.estimates(one).select("grain", "period", F.col("sites").alias("a")).join(sketch.estimates(two).select("grain", "period", F.col("sites").alias("b")), ["grain", "period"])
    return both.select("grain", "period", (F.col("a") == F.col("b")).alias("same"))



@query("a13_hll_merge_bound", WITHIN)
def a13_hll_merge_bound(s, d):
    """Two runs' sketches of the same days, merged."""
    h = hits(s, d)
    parts = [sketch.scope_sketches(sketch.day_sketches(h.where(F.col("id") % 2 == k))) for k in (0, 1)]
    return _bound(rollup.distinct_sites(h), sketch.estimates(sketch.merge_sketches(*parts)))


TOP_SQL = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grain, period ORDER BY {o}) AS INTEGER) AS rn FROM ({t})) WHERE rn <= {n}"


def top_sql(table: str, order: str, n: int = TOP) -> str:
    return TOP_SQL.format(t=table, o=order, n=n)


URLS = O.periods("url", sums=BW)
query("a15_heavy_hitters", O.with_hits(top_sql(URLS, "hits DESC, bandwidth DESC, url", 2000), "orders"))(lambda s, d: topk.top_per_period(rollup.url_counts(hits(s, d)), "url", 2000, "hits", "bandwidth"))
query("a15_approx_hitters", O.with_hits("SELECT family, count(*) AS hits FROM hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "orders"))(lambda s, d: sketch.approx_heavy_hitters(hits(s, d), "family", 5))


@query("a15_bounded_hitters", O.with_hits("SELECT month AS period, url, TRUE AS within FROM (SELECT *, sum(hits) OVER (PARTITION BY month) AS total FROM (SELECT month, url, count(*) AS hits FROM hits GROUP BY ALL)) WHERE hits > total / 100", "orders"))
def a15_bounded_hitters(s, d):
    """Every URL above a hundredth of its month is found with 100 tracked, and its count is within the stated error."""
    h = hits(s, d)
    exact = rollup.url_counts(h).where("grain = 'month'").select("period", "url", F.col("hits").alias("exact"))
    totals = exact.groupBy("period").agg(F.sum("exact").alias("total"))
    found = exact.join(totals, "period").where("exact > total / 100").join(sketch.bounded_hitters(h, "url", 100), ["period", "url"], "left")
    return found.select("period", "url", F.coalesce((F.col("hits") <= F.col("exact")) & (F.col("hits") >= F.col("exact") - F.col("error")), F.lit(False)).alias("within"))


@query("a16_variants", O.with_hits(f"SELECT grain, period, ip, hits, bandwidth FROM ({top_sql(HOSTS, 'bandwidth DESC, hits DESC, ip', 50)})", "orders", O.LOCATED))
def a16_variants(s, d):
    return topk.top_per_period(hosts(s, d).drop("country_code"), "ip", 50, "bandwidth", "hits").drop("rn")


@query("a17_merge_trim", O.with_hits(f"SELECT * EXCLUDE (rn) FROM ({top_sql(URLS, 'hits DESC, bandwidth DESC, url', 10)})", "orders"))
def a17_merge_trim(s, d):
    h = hits(s, d)
    parts = [rollup.url_counts(h.where(F.col("id") % 3 == k)) for k in range(3)]
    return topk.merge_and_trim(parts[0].unionByName(parts[1]).unionByName(parts[2]), "url", 10, "hits", "bandwidth")


@query("a18_partial_final", O.with_hits(URLS, "orders"))
def a18_partial_final(s, d):
    h = hits(s, d)
    return upsert.additive(rollup.url_counts(h.where(F.col("id") % 2 == 0)), rollup.url_counts(h.where(F.col("id") % 2 == 1)), ["grain", "period", "url"], ["hits", "bandwidth"])


# Reports

CS = ("hits", "visits", "files", "pages", "bandwidth", "status_2xx", "status_3xx", "status_4xx", "status_5xx")
SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in CS)
SITES = ", CAST(coalesce(sum(sites), 0) AS BIGINT) AS sites"
query("a19_daily", O.with_hits(f"SELECT date, {SUMS}{SITES} FROM hourly WHERE date LIKE '{MONTH}-%' GROUP BY date", "orders"))(lambda s, d: reports.daily(hourly(s, d), MONTH))
query("a20_hour_dense", O.with_hits(f"SELECT CAST(h AS INTEGER) AS hour, {SUMS}{SITES} FROM range(24) r(h) LEFT JOIN (SELECT * FROM hourly WHERE date LIKE '{MONTH}-%') x ON x.hour = r.h GROUP BY h", "orders"))(lambda s, d: reports.hours_of_day(hourly(s, d), MONTH))
query("a21_month_totals", O.with_hits(f"SELECT {SUMS} FROM hourly WHERE date LIKE '{MONTH}-%'", "orders"))(lambda s, d: reports.totals(hourly(s, d), MONTH))
query("a22_year_totals", O.with_hits(f"SELECT {SUMS} FROM hourly WHERE date LIKE '{YEAR}-%'", "orders"))(lambda s, d: reports.totals(hourly(s, d), YEAR))
query("a23_months", O.with_hits(f"SELECT substr(date, 1, 7) AS month, {SUMS} FROM hourly WHERE date LIKE '{YEAR}-%' GROUP BY 1", "orders"))(lambda s, d: reports.months(hourly(s, d), YEAR))
query("a24_years", O.with_hits(f"SELECT substr(date, 1, 4) AS year, {SUMS} FROM hourly WHERE CAST(substr(date, 1, 4) AS INT) > 0 GROUP BY 1", "orders"))(lambda s, d: reports.years(hourly(s, d)))
query("a25_overall", O.with_hits(f"SELECT {SUMS} FROM hourly", "orders"))(lambda s, d: reports.totals(hourly(s, d)))


@query("a26_site_fallback", O.with_hits("SELECT month AS period, count(DISTINCT ip) AS sites FROM hits GROUP BY 1", "orders"))
def a26_site_fallback(s, d):
    """Half of the months have an estimate (here the exact count), the rest fall back to host rows."""
    h = hits(s, d)
    rows = h.select(F.col("month").alias("period"), "ip").distinct()
    even = rows.where(F.substring("period", 6, 2).cast("int") % 2 == 0).groupBy("period").agg(F.count("*").alias("estimate"))
    return reports.site_fallback(rows, even, rows)


@query("a26_all_time_fallback", O.with_hits("SELECT count(DISTINCT ip) AS sites FROM hits", "orders"))
def a26_all_time_fallback(s, d):
    rows = hits(s, d).select("ip").distinct()
    return reports.all_time_sites(s.createDataFrame([], "period string, estimate long"), rows.limit(0), rows)


SIX = ("hits", "files", "pages", "visits", "sites", "bandwidth")
DAYS = f"SELECT date, {SUMS}{SITES} FROM hourly WHERE date LIKE '{MONTH}-%' GROUP BY date"
query("a27_daily_avg_max", O.with_hits("SELECT " + ", ".join(f"CAST(sum({c}) // count(*) AS BIGINT) AS avg_{c}, max({c}) AS max_{c}" for c in SIX) + f" FROM ({DAYS})", "orders"))(lambda s, d: reports.daily_averages(hourly(s, d), MONTH))
query("a28_hourly_avg_max", O.with_hits("SELECT CAST(round(avg(hits)) AS BIGINT) AS avg_hits, max(hits) AS max_hits FROM hourly WHERE date LIKE '2024-01-%'"))(lambda s, d: reports.hourly_averages(hourly(s, d, "events"), "2024-01"))
query("a29_all_time", O.with_hits("SELECT family, count(*) AS hits FROM hits GROUP BY 1", "orders"))(lambda s, d: reports.all_time(rollup.agent_counts(hits(s, d)), "family"))
query("a30_periods", O.with_hits("SELECT DISTINCT 'month' AS grain, month AS period FROM hits UNION ALL SELECT DISTINCT 'year', year FROM hits", "orders"))(lambda s, d: reports.available_periods(hourly(s, d)))
PCT = "round(hits / sum(hits) OVER () * 1000) / 10 AS percent"
query("a31_percent", O.with_hits(f"SELECT family, hits, {PCT} FROM (SELECT family, count(*) AS hits FROM hits GROUP BY 1 ORDER BY hits DESC, family LIMIT 4)", "orders"))(
    lambda s, d: reports.with_percent(topk.top(reports.all_time(rollup.agent_counts(hits(s, d)), "family"), "family", 4, "hits"))
)
query("a32_distinct_hosts", O.with_hits("SELECT DISTINCT ip FROM hits", "orders"))(lambda s, d: rollup.distinct_hosts(hits(s, d)))

# Visits and windows

query("v01_visits", O.with_hits("SELECT id, ip, ts, new_visit FROM visited"))(lambda s, d: visits.mark_visits(hits(s, d, "events")).select("id", "ip", "ts", "new_visit"))
query("v01_visits_split", O.with_hits("SELECT id, ip, ts, new_visit FROM visited"))(lambda s, d: visits.mark_visits(hits(s, d, "events"), slot_seconds=600).select("id", "ip", "ts", "new_visit"))
query("v02_arrival_order", O.with_hits("SELECT id, ip, ts, coalesce(ts - max(ts) OVER (PARTITION BY ip ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1800, TRUE) AS new_visit FROM hits"))(
    lambda s, d: visits.arrival_visits(hits(s, d, "events")).select("id", "ip", "ts", "new_visit")
)
query("v02_arrival_blocks", _sql["v02_arrival_order"])(lambda s, d: visits.arrival_visits(hits(s, d, "events"), 500).select("id", "ip", "ts", "new_visit"))
query("v03_shared_state", O.with_hits("SELECT id, ip, 'f' || id % 3 AS file, new_visit FROM visited"))(
    lambda s, d: visits.file_visits(hits(s, d, "events").withColumn("file", F.expr("'f' || id % 3"))).select("id", "ip", "file", "new_visit")
)
query("v06_bots_leave_no_state", O.with_hits("SELECT ip, bool_or(NOT is_bot) AS has_state FROM all_hits GROUP BY 1"))(
    lambda s, d: rollup.distinct_hosts(H.to_hits(records(s, d))).join(visits.visit_state(hits(s, d, "events")), "ip", "left").select("ip", F.col("last_seen").isNotNull().alias("has_state"))
)
query("v04_state_merge", O.with_hits("SELECT ip, max(ts) AS last_seen FROM hits GROUP BY 1"))(lambda s, d: visits.visit_state(hits(s, d, "events").where(F.col("ts") >= SPLIT), visits.visit_state(hits(s, d, "events").where(F.col("ts") < SPLIT))))
query("v05_state_prune", O.with_hits("SELECT * FROM (SELECT ip, max(ts) AS last_seen FROM hits GROUP BY 1) WHERE last_seen >= (SELECT max(ts) FROM hits) - 1800"))(lambda s, d: visits.prune_state(visits.visit_state(hits(s, d, "events"))))
query("w01_row_number", O.with_hits(top_sql(URLS, "bandwidth DESC, hits DESC, url"), "orders"))(lambda s, d: topk.top_per_period(rollup.url_counts(hits(s, d)), "url", TOP, "bandwidth", "hits"))
LATEST = "SELECT grain, max(period) AS latest FROM ({t}) GROUP BY 1"
query("w02_two_pass", O.with_hits(f"SELECT * EXCLUDE (rn, latest) FROM ({top_sql(URLS, 'hits DESC, bandwidth DESC, url', 200)}) JOIN ({LATEST.format(t=URLS)}) USING (grain) WHERE rn <= CASE WHEN period = latest THEN 200 ELSE 20 END", "orders"))(
    lambda s, d: topk.prune(rollup.url_counts(hits(s, d)), "url", 20, 200, "hits", "bandwidth")
)
query("w03_running_max", O.with_hits("SELECT id, ip, max(ts) OVER (PARTITION BY ip ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM hits"))(
    lambda s, d: visits.earlier_maximum(hits(s, d, "events")).select("id", "ip", "seen")
)
query("w04_latest", O.with_hits(LATEST.format(t=URLS), "orders"))(lambda s, d: topk.latest(rollup.url_counts(hits(s, d))))

# Rankings


def _top(name: str, table: Callable, table_sql: str, key: str, *metrics: str, more: tuple[str, ...] = ()):
    """A ranking of one month: the rows of the period, best first."""
    order = ", ".join(f"{m} DESC" for m in metrics) + f", {key}"
    query(name, O.with_hits(f"SELECT * FROM ({table_sql}) WHERE period = '{MONTH}' ORDER BY {order} LIMIT {TOP}", "orders", *more))(lambda s, d: topk.top(table(s, d).where(F.col("period") == MONTH), key, TOP, *metrics))


_top("k01_urls_hits", lambda s, d: rollup.url_counts(hits(s, d)), URLS, "url", "hits", "bandwidth")
_top("k02_urls_bw", lambda s, d: rollup.url_counts(hits(s, d)), URLS, "url", "bandwidth", "hits")
_top("k03_hosts_hits", hosts, HOSTS, "ip", "hits", "bandwidth", more=(O.LOCATED,))
_top("k04_hosts_bw", hosts, HOSTS, "ip", "bandwidth", "hits", more=(O.LOCATED,))
_top("k05_refs", lambda s, d: rollup.referrer_counts(hits(s, d), SITE), O.periods("ref_host", where=f"ref_host IS NOT NULL AND ref_host <> '{SITE}'"), "ref_host", "hits")
_top("k06_agents", lambda s, d: rollup.agent_counts(hits(s, d)), O.periods("family"), "family", "hits")
_top("k07_countries", lambda s, d: rollup.country_counts(addresses(s, d)), O.periods("country_code", "located"), "country_code", "hits", more=(O.LOCATED,))
CODES = "SELECT 'status' AS kind, CAST(status AS VARCHAR) AS code, count(*) AS hits FROM hits WHERE month = '{m}' GROUP BY ALL UNION ALL SELECT 'method', method, count(*) FROM hits WHERE month = '{m}' GROUP BY ALL UNION ALL SELECT 'proto', proto, count(*) FROM hits WHERE month = '{m}' GROUP BY ALL".replace("{m}", MONTH)


@query("k08_codes", O.with_hits(CODES, "orders"))
def k08_codes(s, d):
    h = hits(s, d)
    parts = [(rollup.status_counts, "status", "status"), (rollup.method_counts, "method", "method"), (rollup.protocol_counts, "proto", "proto")]
    rows = [f(h).where(F.col("period") == MONTH).select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("code"), "hits") for f, kind, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).orderBy("kind", F.desc("hits"), "code")


query("k10_partial_select", O.with_hits(f"SELECT * FROM ({URLS}) ORDER BY bandwidth DESC, hits DESC, url, grain, period LIMIT 15", "orders"))(
    lambda s, d: rollup.url_counts(hits(s, d)).orderBy(F.desc("bandwidth"), F.desc("hits"), "url", "grain", "period").limit(15)
)
RANKED = f"SELECT *, row_number() OVER (PARTITION BY grain, period ORDER BY hits DESC, bandwidth DESC, url) AS rh, row_number() OVER (PARTITION BY grain, period ORDER BY bandwidth DESC, hits DESC, url) AS rb FROM ({URLS})"


@query("k09_pretrim", O.with_hits(f"SELECT grain, period, url, hits, bandwidth FROM ({RANKED}) JOIN ({LATEST.format(t=URLS)}) USING (grain) WHERE period >= latest OR rh <= 5 OR rb <= 5", "orders"))
def k09_pretrim(s, d):
    urls = rollup.url_counts(hits(s, d))
    return topk.pretrim(urls, "url", 5, topk.latest(urls)).select("grain", "period", "url", "hits", "bandwidth")


REFS = O.periods("ref_host", where="ref_host IS NOT NULL")
query("k11_prune", O.with_hits(f"SELECT * EXCLUDE (rn, latest) FROM ({top_sql(REFS, 'hits DESC, ref_host', 1000000)}) JOIN ({LATEST.format(t=REFS)}) USING (grain) WHERE rn <= 8 OR period = latest", "orders"))(
    lambda s, d: topk.prune(rollup.referrer_counts(hits(s, d)), "ref_host", 8, None, "hits")
)
STATUS = O.periods("status")
query(
    "k13_other_bucket",
    O.with_hits(f"SELECT grain, period, CASE WHEN rn <= 3 THEN CAST(status AS VARCHAR) ELSE 'Other' END AS label, CAST(least(rn, 4) AS INTEGER) AS position, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / any_value(total) * 1000) / 10 AS percent FROM (SELECT *, sum(hits) OVER (PARTITION BY grain, period) AS total, row_number() OVER (PARTITION BY grain, period ORDER BY hits DESC, status) AS rn FROM ({STATUS})) GROUP BY grain, period, label, position", "orders"),
)(lambda s, d: topk.head_and_other(rollup.status_counts(hits(s, d)), "status", 3))

# Sets and merges

LEDGER_SQL = "SELECT '/logs/' || p_size || '/' || p_partkey % 50 AS path, p_partkey % 90 AS inode, CAST(floor(p_retailprice) AS BIGINT) AS done, p_size FROM part"


def ledger_rows(s, d) -> tuple[DataFrame, DataFrame]:
    """(live, archived) ledger entries with paths and inodes that repeat; some entries are in both."""
    rows = s.sql(LEDGER_SQL.replace("FROM part", "FROM {part}"), part=s.read.parquet(f"{d}/part.parquet"))
    return rows.where("p_size >= 20").drop("p_size"), rows.where("p_size < 30").drop("p_size")


LIVE, ARCHIVED = (f"SELECT path, inode, done FROM ({LEDGER_SQL}) WHERE p_size {x}" for x in (">= 20", "< 30"))
query("u01_union_all", f"{LIVE} UNION ALL {ARCHIVED}")(lambda s, d: upsert.union_all(*ledger_rows(s, d)))
query("u02_set_union", f"{LIVE} UNION {ARCHIVED}")(lambda s, d: upsert.distinct_union(*ledger_rows(s, d)))
query("u04_distinct_files", f"SELECT path FROM ({LIVE}) UNION SELECT path FROM ({ARCHIVED})")(lambda s, d: upsert.distinct_rows(upsert.union_all(*ledger_rows(s, d)), ["path"]))


@query("u03_insert_ignore", O.with_hits("SELECT DISTINCT ip FROM hits"))
def u03_insert_ignore(s, d):
    h = hits(s, d, "events")
    old = h.where(F.col("ts") < SPLIT).select("ip").distinct()
    return old.unionByName(upsert.insert_ignore(old, h.select("ip"), ["ip"]))


query("u05_dedupe_retired", f"SELECT DISTINCT path, inode FROM ({ARCHIVED})")(lambda s, d: upsert.distinct_rows(ledger_rows(s, d)[1], ["path", "inode"]))


@query("m01_additive", O.with_hits(f"SELECT date, hour, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('hits', 'bandwidth'))} FROM hourly GROUP BY ALL"))
def m01_additive(s, d):
    h = hits(s, d, "events")
    parts = [rollup.hourly_of(h.where(F.col("id") % 2 == k)).select("date", "hour", "hits", "bandwidth") for k in (0, 1)]
    return upsert.additive(*parts, ["date", "hour"], ["hits", "bandwidth"])


@query("m02_max", O.with_hits("SELECT ip, max(ts) AS last_seen FROM hits GROUP BY 1", "orders"))
def m02_max(s, d):
    h = hits(s, d).select("ip", F.col("ts").alias("last_seen"))
    return upsert.maximum(h.where("last_seen % 2 = 0"), h.where("last_seen % 2 = 1"), ["ip"], "last_seen")


@query("m04_conditional", O.with_hits("SELECT ip, coalesce(max(CASE WHEN id % 2 = 1 THEN nullif(country_code, '--') END), max(CASE WHEN id % 2 = 0 THEN country_code END), '--') AS country_code FROM located GROUP BY 1", "orders", O.LOCATED))
def m04_conditional(s, d):
    h = located(s, d)
    return upsert.known_country(h.where("id % 2 = 0"), h.where("id % 2 = 1"), "ip")


query("m05_replace", O.with_hits("SELECT ip, id, ts, status FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY id DESC) AS rn FROM hits) WHERE rn = 1"))(lambda s, d: upsert.replace_latest(hits(s, d, "events").select("ip", "id", "ts", "status"), ["ip"], "id"))
query("m06_retain", O.with_hits(f"SELECT ip, max(ts) AS last_seen FROM hits GROUP BY 1 HAVING max(ts) >= {SPLIT}"))(lambda s, d: upsert.retain(visits.visit_state(hits(s, d, "events")), "last_seen", SPLIT))

query(
    "o06_chart_data",
    O.with_hits("SELECT month, string_agg(label, ',' ORDER BY date) AS labels, string_agg(CAST(hits AS VARCHAR), ',' ORDER BY date) AS hits FROM (SELECT substr(date, 1, 7) AS month, date, split_part(date, '-', 3) AS label, count(*) AS hits FROM hits GROUP BY ALL) GROUP BY month", "orders"),
)(lambda s, d: reports.chart_data(hits(s, d).groupBy("date").agg(F.count("*").alias("hits"))))


def _shares_sql(table: str, key: str, n: int, *more: str) -> str:
    ranked = f"SELECT *, sum(hits) OVER (PARTITION BY grain, period) AS total, row_number() OVER (PARTITION BY grain, period ORDER BY hits DESC, {key}) AS rn FROM ({table})"
    parts = f"SELECT grain, period, least(rn, {n + 1}) AS place, CASE WHEN rn <= {n} THEN CAST({key} AS VARCHAR) ELSE 'Other' END AS label, CAST(sum(hits) AS BIGINT) AS hits, any_value(total) AS total FROM ({ranked}) GROUP BY ALL"
    return O.with_hits(f"SELECT grain, period, string_agg(label || ' (' || printf('%.1f', round(hits / total * 1000) / 10) || '%)', ',' ORDER BY place) AS labels, string_agg(CAST(hits AS VARCHAR), ',' ORDER BY place) AS hits FROM ({parts}) GROUP BY ALL", "orders", *more)


query("o06_status_shares", _shares_sql(STATUS, "status", 3))(lambda s, d: reports.share_data(rollup.status_counts(hits(s, d)), "status", 3))
query("o06_agent_shares", _shares_sql(O.periods("family"), "family", 4))(lambda s, d: reports.share_data(rollup.agent_counts(hits(s, d)), "family", 4))
query("o06_country_shares", _shares_sql(O.periods("country_code", "located"), "country_code", 2, O.LOCATED))(lambda s, d: reports.share_data(rollup.country_counts(addresses(s, d)), "country_code", 2))
query(
    "o06_activity",
    O.with_hits("SELECT substr(date, 1, 7) AS month, " + ", ".join(f"string_agg({x}, ',' ORDER BY date) AS {c}" for c, x in (("labels", "right(date, 2)"), ("hits", "hits || ''"), ("pages", "pages || ''"), ("files", "files || ''"), ("megabytes", "printf('%.2f', round(CAST(bandwidth AS DOUBLE) / 1048576 * 100) / 100)"))) + " FROM (SELECT date, sum(hits) AS hits, sum(pages) AS pages, sum(files) AS files, sum(bandwidth) AS bandwidth FROM hourly GROUP BY 1) GROUP BY 1", "orders"),
)(lambda s, d: reports.activity_data(reports.daily(hourly(s, d))))


@query("f03_switches", "SELECT u AS urls, r AS refs, h AS hosts, t AS tab FROM (VALUES (TRUE), (FALSE)) a(u), (VALUES (TRUE), (FALSE)) b(r), (VALUES (TRUE), (FALSE)) c(h), (VALUES ('hourly'), ('agents'), ('status'), ('methods'), ('protocols'), ('sketches'), ('countries'), ('country_names'), ('urls'), ('refs'), ('hosts')) x(t) WHERE (t <> 'urls' OR u) AND (t <> 'refs' OR r) AND (t <> 'hosts' OR h)")
def f03_switches(s, d):
    """The tables that a store with these switches keeps."""
    from .store import Options

    rows = [(u, r, h, t) for u in (True, False) for r in (True, False) for h in (True, False) for t in Options(urls=u, refs=r, hosts=h).tables(countries=True)]
    return s.createDataFrame(rows, "urls boolean, refs boolean, hosts boolean, tab string")


# Formats

ORDERS_N = "SELECT o_orderkey AS k, CAST(floor(o_totalprice * o_totalprice * (o_orderkey % 7) * (o_orderkey % 1000)) AS BIGINT) AS n FROM orders"


def numbers(s, d):
    return s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS k", "CAST(floor(o_totalprice * o_totalprice * (o_orderkey % 7) * (o_orderkey % 1000)) AS BIGINT) AS n")


def _case(n: str, places: str) -> str:
    return f"CASE WHEN {places} >= 100 THEN round({places}, 0) WHEN {places} >= 10 THEN round({places}, 1) ELSE round({places}, 2) END".replace("{n}", n)


COMPACT = f"""WITH a AS ({ORDERS_N}), b AS (SELECT k, n, CASE WHEN n < 1e6 THEN 1 WHEN n < 1e9 THEN 2 WHEN n < 1e12 THEN 3 ELSE 4 END AS p,
  CASE WHEN n < 1e6 THEN n / 1e3 WHEN n < 1e9 THEN n / 1e3 / 1e3 WHEN n < 1e12 THEN n / 1e3 / 1e3 / 1e3 ELSE n / 1e3 / 1e3 / 1e3 / 1e3 END AS x FROM a),
 c AS (SELECT *, {_case('n', 'x')} AS r FROM b), e AS (SELECT k, n, CASE WHEN r >= 1000 AND p < 4 THEN p + 1 ELSE p END AS p, CASE WHEN r >= 1000 AND p < 4 THEN round(r / 1000, 2) ELSE r END AS r FROM c)
 SELECT k, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE rtrim(rtrim(printf('%.2f', r), '0'), '.') || ['', 'k', 'm', 'b', 't'][p + 1] END AS shown FROM e"""
query("x01_thousands", f"SELECT k, format('{{:,}}', n) AS shown FROM ({ORDERS_N})")(lambda s, d: numbers(s, d).select("k", fmt.thousands(F.col("n")).alias("shown")))
query("x02_compact", COMPACT)(lambda s, d: numbers(s, d).select("k", fmt.compact(F.col("n")).alias("shown")))
query(
    "x03_bytes",
    "SELECT k, CASE WHEN n < 1024 THEN n || ' B' " + " ".join(f"WHEN n < {1024 ** (p + 1)} THEN printf('%.{c}f', n / {1024**p}) || ' {u}'" for p, u, c in ((1, "KB", 1), (2, "MB", 1), (3, "GB", 2), (4, "TB", 2))) + f" ELSE printf('%.2f', n / {1024**5}) || ' PB' END AS shown FROM ({ORDERS_N})",
)(lambda s, d: numbers(s, d).select("k", fmt.byte_size(F.col("n")).alias("shown")))
query("x12_exact", f"SELECT k, format('{{:,}}', n) AS shown FROM ({ORDERS_N})")(lambda s, d: numbers(s, d).select("k", fmt.estimate_text(F.col("n"), 24).alias("shown")))
query("x12_compact", COMPACT)(lambda s, d: numbers(s, d).select("k", fmt.estimate_text(F.col("n"), 14).alias("shown")))
query("x04_percent", f"SELECT k, printf('%.1f', round(k / (k + 977) * 1000) / 10) || '%' AS shown FROM ({ORDERS_N})")(lambda s, d: numbers(s, d).select("k", fmt.percent_text(F.col("k"), F.col("k") + 977).alias("shown")))


def _map(column: str, labels: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + f" ELSE {other} END"


CODE = "SELECT DISTINCT CAST(o_orderkey % 600 AS INTEGER) AS code FROM orders"


def codes(s, d):
    return s.read.parquet(f"{d}/orders.parquet").selectExpr("CAST(o_orderkey % 600 AS INTEGER) AS code").distinct()


query("x05_status_label", f"SELECT code, {_map('code', {0: STATUS_ZERO} | {k: f'Code {k} - {v}' for k, v in STATUS_LABELS.items()}, chr(39) + 'Code ' + chr(39) + ' || code')} AS label FROM ({CODE})")(lambda s, d: codes(s, d).select("code", fmt.status_label(F.col("code")).alias("label")))
query("x06_short_label", f"SELECT code, {_map('code', {0: STATUS_ZERO_SHORT} | SHORT_STATUS_LABELS, 'CAST(code AS VARCHAR)')} AS label FROM ({CODE})")(lambda s, d: codes(s, d).select("code", fmt.short_status_label(F.col("code")).alias("label")))
query("x07_month_name", f"SELECT code, {_map('code', {0: MONTH_NAMES[0]} | dict(enumerate(MONTH_NAMES, 1)), chr(39) + 'Unknown' + chr(39))} AS name FROM ({CODE}) WHERE code < 20")(lambda s, d: codes(s, d).where("code < 20").select("code", fmt.month_name(F.col("code")).alias("name")))
query("x08_hour_label", "SELECT CAST(h AS INTEGER) AS hour, lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS label FROM range(24) r(h)")(lambda s, d: s.range(24).select(F.col("id").cast("int").alias("hour"), fmt.hour_label(F.col("id")).alias("label")))
query("x09_mb", f"SELECT k, round(CAST(n AS DOUBLE) / 1048576 * 100) / 100 AS mb FROM ({ORDERS_N})")(lambda s, d: numbers(s, d).select("k", fmt.megabytes(F.col("n")).alias("mb")))
COLOURS = ", ".join(f"'{c}'" for c in PALETTE)
query("x10_colour", f"SELECT code, CASE WHEN code BETWEEN 200 AND 299 THEN '#52c493' WHEN code BETWEEN 300 AND 399 THEN '#7090ff' WHEN code BETWEEN 400 AND 499 THEN '#ffc055' WHEN code BETWEEN 500 AND 599 THEN '#ff7a7a' ELSE [{COLOURS}][code % 10 + 1] END AS colour FROM ({CODE})")(lambda s, d: codes(s, d).select("code", fmt.status_colour(F.col("code"), F.col("code")).alias("colour")))
query("x11_labels", O.with_hits("SELECT DISTINCT date, split_part(date, '-', 3) AS day, [" + ", ".join(f"'{m[:3]}'" for m in MONTH_NAMES) + "][CAST(substr(date, 6, 2) AS INT)] AS month FROM hits", "orders"))(
    lambda s, d: hits(s, d).select("date").distinct().select("date", fmt.day_label(F.col("date")).alias("day"), fmt.month_short(F.substring("date", 6, 2).cast("int")).alias("month"))
)
