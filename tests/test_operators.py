import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.operators import hits as H
from logquarry.operators import reports, rollup, sketch, topk, upsert, visits

#: ip, time, path, status, bytes, referrer: two visitors on either side of a month's end, one answer of each class.
ROWS = [
    ("172.16.4.9", "30/Apr/2023:22:40:10", "/start", 200, 900, "https://search.example/?q=oak"),
    ("172.16.4.9", "30/Apr/2023:23:05:00", "/img/oak.png", 200, 4100, "https://shop.test/start"),
    ("172.16.4.9", "30/Apr/2023:23:40:00", "/start", 304, 0, "https://shop.test/start"),
    ("172.16.7.1", "01/May/2023:06:00:00", "/list.json?page=2", 206, 33, "-"),
    ("172.16.7.1", "01/May/2023:06:29:59", "/old", 301, 12, "https://forum.example/t/8"),
    ("172.16.7.1", "01/May/2023:07:00:00", "/nowhere", 404, 210, "https://forum.example/t/9"),
    ("172.16.4.9", "02/May/2023:01:00:00", "/start", 200, 900, "https://forum.example/t/9"),
    ("172.16.8.8", "11/Nov/2024:11:11:11", "/cart", 502, 77, "https://shop.test/start"),
    ("172.16.8.8", "11/Nov/2024:11:20:11", "/cart", 200, 640, "https://search.example/?q=cart"),
]


@pytest.fixture(scope="module")
def wide(spark, make_line):
    texts = [make_line(ip, f"{t} +0000", f"GET {p} HTTP/1.1", s, b, r) for ip, t, p, s, b, r in ROWS]
    return H.hits(spark.createDataFrame(list(enumerate(texts)), "id long, value string")).cache()


def hourly(hits):
    return rollup.hourly(visits.mark_visits(hits))


def test_worked_example(wide):
    t = reports.totals(hourly(wide)).first()
    assert (t["hits"], t["visits"], t["pages"], t["files"], t["bandwidth"]) == (9, 6, 3, 2, 6872)
    assert (t["status_2xx"], t["status_3xx"], t["status_4xx"], t["status_5xx"]) == (5, 2, 1, 1)
    assert {r["year"]: r["hits"] for r in reports.years(hourly(wide)).collect()} == {"2023": 7, "2024": 2}
    assert {r["month"]: r["visits"] for r in reports.months(hourly(wide)).collect()} == {"2023-04": 2, "2023-05": 3, "2024-11": 1}
    refs = {(r["period"], r["ref_host"]): r["hits"] for r in rollup.referrer_counts(wide, "shop.test").collect()}
    assert refs["2023-05", "forum.example"] == 3 and refs["2023", "search.example"] == 1
    assert not any(host == "shop.test" for _, host in refs)
    urls = {(r["period"], r["url"]): (r["hits"], r["bandwidth"]) for r in rollup.url_counts(wide).collect()}
    assert urls["2023", "/start"] == (3, 1800) and urls["2023-05", "/list.json"] == (1, 33)
    status = {(r["period"], r["status"]): r["hits"] for r in rollup.status_counts(wide).collect()}
    assert status["2023", 404] == 1 and status["2024-11", 502] == 1 and ("2024", 301) not in status


@pytest.mark.parametrize("with_state", [False, True])
@pytest.mark.parametrize("slot", [60, 3600, 7000])
def test_hourly_in_one_pass(spark, with_state, slot):
    """Visits decided on groups equal those marked on hits, with ties, gaps of exactly 30 minutes, offsets and a state."""
    rng = np.random.default_rng(slot)
    rows = []
    for i in range(400):
        ts = 1_700_000_000 + int(rng.choice([0, 1, 1800, 1801, 3600])) * int(rng.integers(0, 40)) + int(rng.integers(0, 3))
        local = ts + 3600 * int(rng.integers(-1, 2))
        rows.append((i, f"h{int(rng.integers(0, 4))}", ts, f"d{local // 86400}", local // 3600 % 24, int(rng.integers(0, 99)), "2xx", "page"))
    h = spark.createDataFrame(rows, "id long, ip string, ts long, date string, hour int, bytes long, status_class string, content string")
    state = spark.createDataFrame([("h0", 1_700_000_000 - 1800), ("h1", 1_700_000_000 - 1801), ("gone", 5)], "ip string, last_seen long") if with_state else None
    marked = visits.mark_visits(h, state, slot)
    want, ordered = {}, sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    seen = {"h0": 1_700_000_000 - 1800, "h1": 1_700_000_000 - 1801} if with_state else {}
    for r in ordered:
        want[r[0]] = r[1] not in seen or r[2] - seen[r[1]] > 1800
        seen[r[1]] = r[2]
    assert {r["id"]: r["new_visit"] for r in marked.collect()} == want
    key = ("date", "hour")
    assert sorted(map(str, rollup.hourly_of(h, state, slot).orderBy(*key).collect())) == sorted(map(str, rollup.hourly(marked).select(*rollup.hourly_of(h, state, slot).columns).collect()))


def test_earlier_maximum_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"h{int(rng.integers(0, 3))}", int(rng.integers(0, 1000))) for i in rng.permutation(300)]
    got = {r["id"]: r["seen"] for r in visits.earlier_maximum(spark.createDataFrame(rows, "id long, ip string, ts long"), block=16).collect()}
    top = {}
    for i, ip, ts in sorted(rows):
        assert got[i] == top.get(ip)
        top[ip] = max(ts, top.get(ip, ts))


@pytest.mark.parametrize(("clock", "n"), [(("14:00", "14:20", "15:01"), 2), (("14:00", "14:30"), 1), (("14:00", "14:31"), 2)])
def test_visit_gap(lines, make_line, clock, n):
    h = H.hits(lines([make_line(time=f"01/Jan/2025:{c}:00 +0000") for c in clock]))
    assert visits.mark_visits(h).where("new_visit").count() == n


def test_visit_goes_on_over_runs(spark, lines, make_line):
    first = H.hits(lines([make_line(time="01/Jan/2025:14:00:00 +0000")]))
    second = H.hits(lines([make_line(time="01/Jan/2025:14:10:00 +0000")]))
    state = visits.visit_state(first)
    assert visits.mark_visits(second, state).where("new_visit").count() == 0
    assert visits.visit_state(second, state).count() == 1


def test_state_prune(spark):
    state = spark.createDataFrame([("a", 1000), ("b", 1200), ("c", 2000)], "ip string, last_seen long")
    top = spark.createDataFrame([(3000,)], "max_seen long")
    assert {r["ip"] for r in visits.prune_state(state, top).collect()} == {"b", "c"}
    assert visits.prune_state(state, spark.createDataFrame([(0,)], "max_seen long")).count() == 3


def test_bots_leave_no_trace(lines, make_line):
    assert H.hits(lines([make_line(agent="Googlebot/2.1")])).count() == 0
    assert H.hits(lines([make_line(agent="Googlebot/2.1")]), drop_bots=False).count() == 1


def test_equal_addresses_count_once(lines, make_line):
    h = H.hits(lines([make_line(ip=i) for i in ("2001:db8::1", "2001:DB8:0:0:0:0:0:1", "010.0.0.1", "10.0.0.1")]))
    assert hourly(h).first()["sites"] == 2


def counts(spark, rows):
    return spark.createDataFrame([("month", p, k, h, b) for p, k, h, b in rows], "grain string, period string, url string, hits long, bandwidth long")


def test_pretrim_keeps_both_rankings(spark):
    rows = [("2020-01", "a", 100, 1), ("2020-01", "b", 90, 2), ("2020-01", "c", 5, 1000), ("2020-01", "d", 4, 900), ("2020-01", "e", 50, 50), ("2020-02", "z", 1, 1)]
    df = counts(spark, rows)
    got = topk.pretrim(df, "url", 2, topk.latest(df)).where("period = '2020-01'")
    assert {r["url"] for r in got.collect()} == {"a", "b", "c", "d"}


def test_prune(spark):
    df = counts(spark, [("2020-01", f"u{i:02d}", i, i) for i in range(30)] + [("2020-02", "x", 1, 1)])
    assert topk.prune(df, "url", 20, 2000, "hits", "bandwidth").where("period = '2020-01'").count() == 20
    only = counts(spark, [("2020-01", f"u{i:02d}", i, i) for i in range(30)])
    assert topk.prune(only, "url", 20, 2000, "hits", "bandwidth").count() == 30
    assert topk.prune(df, "url", 0, 0, "hits").count() == 31


def test_merge_and_trim_breaks_ties_by_key(spark):
    df = counts(spark, [("p", "b", 10, 0), ("p", "a", 5, 0), ("p", "c", 1, 0), ("p", "a", 5, 0)])
    assert [r["url"] for r in topk.merge_and_trim(df, "url", 2, "hits", "bandwidth").orderBy(F.desc("hits"), "url").collect()] == ["a", "b"]


def test_dense_hours(spark, wide):
    rows = reports.hours_of_day(hourly(wide)).orderBy("hour").collect()
    assert [r["hour"] for r in rows] == list(range(24))
    assert sum(r["hits"] for r in rows) == 9 and rows[3]["hits"] == 0 and rows[6]["hits"] == 2


def test_empty_inputs(spark, lines):
    none = H.hits(lines([]))
    assert hourly(none).count() == 0 and reports.totals(hourly(none)).first()["hits"] == 0
    assert reports.hours_of_day(hourly(none)).count() == 24
    assert reports.available_periods(hourly(none)).count() == 0


def test_site_fallback(spark):
    hosts = spark.createDataFrame([("2024-01", x) for x in "abc"] + [("2024-02", "a")], "period string, ip string")
    est = spark.createDataFrame([("2024-02", 42)], "period string, estimate long")
    assert {r["period"]: r["sites"] for r in reports.site_fallback(hosts, est, hosts).collect()} == {"2024-01": 3, "2024-02": 42}
    none = spark.createDataFrame([], "period string, estimate long")
    assert reports.all_time_sites(none, hosts.select("ip"), hosts.limit(0)).first()["sites"] == 3
    assert reports.all_time_sites(none, hosts.limit(0), hosts).first()["sites"] == 3


def test_sketch_merge(spark):
    def days(a, b):
        return spark.range(a, b).select(F.lit("2024-01-01").alias("date"), F.col("id").cast("string").alias("ip"))

    parts = [sketch.scope_sketches(sketch.day_sketches(days(a, b), 10)) for a, b in ((0, 800), (500, 1100))]
    rows = sketch.estimates(sketch.merge_sketches(*parts)).collect()
    assert len(rows) == 4 and all(1000 < r["sites"] < 1200 for r in rows)


@pytest.mark.parametrize("precision", [4, 10, 14])
@pytest.mark.parametrize("step", [3, 700, 5000])
def test_estimates_do_not_depend_on_merges(spark, precision, step):
    """Of few, some and many visitors (listed ones, registers only after the merge, registers before it)."""

    def part(a, b):
        rows = spark.range(a * step, b * step).select(F.lit("2024-01-01").alias("date"), F.col("id").cast("string").alias("ip"))
        return sketch.scope_sketches(sketch.day_sketches(rows, precision))

    a, b, c, whole = part(0, 1), part(1, 2), part(2, 4), part(0, 4)
    merges = [whole, sketch.merge_sketches(whole), sketch.merge_sketches(whole, whole), sketch.merge_sketches(a, b, c), sketch.merge_sketches(c, a, b, a), sketch.merge_sketches(sketch.merge_sketches(b, a), c), sketch.merge_sketches(whole, a)]
    got = {tuple(sorted((r["grain"], r["sites"]) for r in sketch.estimates(m).collect())) for m in merges}
    assert len(got) == 1 and all(abs(n - 4 * step) <= max(1, 4 * step * 5 * 1.04 / 2 ** (precision / 2)) for _, n in got.pop())


def test_conditional_country(spark):
    old = spark.createDataFrame([("a", "--"), ("b", "DE"), ("c", "DE")], "ip string, country_code string")
    new = spark.createDataFrame([("a", "FR"), ("b", "--"), ("c", "US"), ("d", "--")], "ip string, country_code string")
    assert {r["ip"]: r["country_code"] for r in upsert.known_country(old, new, "ip").collect()} == {"a": "FR", "b": "DE", "c": "US", "d": "--"}


def test_bounded_hitters(spark):
    """Far more items than are kept: counts stay within the error, the error within its bound, frequent items are found."""
    rng = np.random.default_rng(9)
    rows = [("2024-01", f"u{int(x)}", 10) for x in rng.zipf(1.4, 30_000) % 5000] + [("2024-02", "only", 7)] * 40
    frame = spark.createDataFrame(rows, "month string, url string, bytes long").repartition(3)
    exact = {(r["month"], r["url"]): r["count"] for r in frame.groupBy("month", "url").count().collect()}
    got = {(r["period"], r["url"]): r for r in sketch.bounded_hitters(frame, "url", 50).collect()}
    assert len(got) < len(exact) and ("2024-02", "only") in got and got["2024-02", "only"]["bandwidth"] == 280
    assert all(exact[k] - r["error"] <= r["hits"] <= exact[k] and r["error"] <= 30_000 / 50 for k, r in got.items())
    assert all(k in got for k, n in exact.items() if n > 30_000 / 50)
