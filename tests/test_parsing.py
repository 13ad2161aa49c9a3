import ipaddress

import pytest
from pyspark.sql import functions as F

from logquarry.functions import enrich, fmt, parsing
from logquarry.operators import hits as H


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_well_formed(lines, make_line):
    r = H.parse_lines(lines([make_line(request="GET /a?b=1 HTTP/1.1", size="42", referer="https://x.test/", agent="A B")])).first()
    assert (r["ip"], r["method"], r["path"], r["proto"], r["status"], r["bytes"], r["referer"], r["user_agent"]) == ("10.0.0.1", "GET", "/a?b=1", "HTTP/1.1", 200, 42, "https://x.test/", "A B")


@pytest.mark.parametrize(
    "change",
    [
        {"time": "01/Foo/2025:00:00:00 +0000"}, {"time": "01/Jan/2025"}, {"request": "GET /x"}, {"request": ""}, {"request": "GET /a b HTTP/1.1"},
        {"request": "\x16\x03\x01"}, {"request": "GET /caf\u00e9 HTTP/1.1"}, {"request": "SSH-2.0-Go"}, {"status": "20"}, {"status": "abc"},
    ],
)
def test_malformed_lines_are_dropped(lines, make_line, change):
    assert H.parse_lines(lines([make_line(**change)])).count() == 0


@pytest.mark.parametrize("text", ["", "short", "a b c d", None])
def test_short_lines_are_dropped(lines, text):
    assert H.parse_lines(lines([text])).count() == 0


def test_missing_quotes_are_dropped(lines, make_line):
    whole = make_line(referer="http://r/", agent="UA")
    broken = [whole.replace('"GET', "GET"), whole.replace('HTTP/1.1"', "HTTP/1.1"), whole.replace('"http', "http"), whole[:-1], whole.replace('"UA', "UA")]
    assert H.parse_lines(lines(broken)).count() == 0


def test_odd_fields(lines, make_line):
    rows = H.parse_lines(lines([make_line(size="-"), make_line(size="12x"), make_line(size="9" * 30), make_line(request="CONNECT example.com:443 HTTP/1.1"), make_line(request="GET /" + "a" * 1000 + " HTTP/1.1"), make_line(agent="", referer="")])).orderBy("id").collect()
    assert [r["bytes"] for r in rows[:3]] == [0, 0, 0]
    assert rows[3]["path"] == "example.com:443"
    assert len(rows[4]["path"]) == 1001
    assert (rows[5]["referer"], rows[5]["user_agent"]) == ("", "")


def test_separator_text_in_fields_is_kept(lines, make_line):
    r = H.parse_lines(lines([make_line(agent="a\x01b", referer="r\x01s")])).first()
    assert (r["user_agent"], r["referer"]) == ("a\x01b", "r\x01s")


@pytest.mark.parametrize("month", range(1, 13))
def test_months_and_wall_clock(lines, make_line, month):
    name = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")[month - 1]
    r = H.to_hits(H.parse_lines(lines([make_line(time=f"05/{name}/2024:23:30:00 -0800")]))).first()
    assert (r["date"], r["month"], r["year"], r["hour"]) == (f"2024-{month:02d}-05", f"2024-{month:02d}", "2024", 23)


def test_epoch_follows_the_offset(lines, make_line):
    times = ["01/Jan/2025:14:00:00 +0000", "01/Jan/2025:16:00:00 +0200", "01/Jan/2025:12:00:00 -0200", "01/Jan/2025:14:00:00 *0000", "31/Feb/2025:14:00:00 +0000", "01/Jan/2025:24:00:00 +0000"]
    rows = H.to_hits(H.parse_lines(lines([make_line(time=t) for t in times]))).collect()
    assert [r["ts"] for r in rows] == [1735740000] * 3  # bad sign, day and hour are left out


@pytest.mark.parametrize(("path", "ext"), [("/assets/app.min.js", ".js"), ("/a.b.c/index", ""), ("/foo.d/bar", ""), ("/foo/", ""), ("", ""), ("/x.", ".")])
def test_extension(spark, path, ext):
    assert one(spark, path, parsing.file_extension) == ext


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://example.com:8443/path?a=1", "example.com"), ("https://ref.example.org?src=home", "ref.example.org"), ("mailto:someone", None), ("https:///missing", None), ("https:///x://y", None), ("https://U:p@h/", "U"), ("http://a#b", "a#b"), ("://", None)],
)
def test_referrer_host(spark, url, host):
    assert one(spark, url, parsing.referrer_host) == host


@pytest.mark.parametrize("text", ["1.2.3.4", "010.001.0.7", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "", "1.2.3.-4"])
def test_ipv4(spark, text):
    parts = text.split(".")
    good = len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts)
    want = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in parts))) if good else None
    assert one(spark, text, parsing.ipv4_number) == want
    assert one(spark, text, parsing.ip_key) == (".".join(str(int(p)) for p in parts) if good else text)


@pytest.mark.parametrize("text", ["::", "::1", "2001:DB8::1", "2001:db8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::2::3", ":::", "1:2:3", "g::1", "1:2:3:4:5:6:7:8:9", "12345::", "fe80::1%eth0", ":1:2:3:4:5:6:7"])
def test_ipv6(spark, text):
    try:
        digits = None if "%" in text else f"{int(ipaddress.IPv6Address(text)):032x}"
        want = digits and ":".join(digits[i : i + 4] for i in range(0, 32, 4))
    except ValueError:
        want = None
    assert one(spark, text, parsing.ipv6_groups) == want


def test_status_classes(spark):
    df = spark.createDataFrame([(s,) for s in (100, 0, 200, 299, 302, 404, 500, 999)], "s int").select("s", parsing.status_class(F.col("s")).alias("c"))
    assert {r["s"]: r["c"] for r in df.collect()} == {100: "3xx", 0: "3xx", 200: "2xx", 299: "2xx", 302: "3xx", 404: "4xx", 500: "5xx", 999: "5xx"}


@pytest.mark.parametrize(("agent", "bot"), [("", False), ("Mozilla/5.0 Firefox/1", False), ("curl/8.0", True), ("Wget/1", True), ("My Crawler", True), ("Somebot", True), ("robots", False), ("FeedReader", True), ("Mozilla/5.0 (compatible; Googlebot/2.1)", True), ("python-requests/2", True)])
def test_bots(spark, agent, bot):
    assert one(spark, agent, lambda c: enrich.is_bot(c, enrich.family(c))) is bot


def test_unlisted_family_is_checked_by_its_name(spark):
    assert one(spark, "SemrushBot-BA", lambda c: enrich.is_bot(F.lit("x"), c)) is True


def test_country_ranges(spark):
    ranges = spark.createDataFrame([(16777216, 16777471, "AU", "Australia"), (16842752, 17301503, "TH", "Thailand")], "first long, last long, country_code string, country_name string")
    ips = spark.createDataFrame([("1.0.0.0",), ("1.0.0.255",), ("1.0.1.0",), ("1.3.9.9",), ("1.8.0.0",), ("-",), ("::1",), (None,)], "ip string")
    got = {r["ip"]: r["country_code"] for r in enrich.with_country(ips, ranges).collect()}
    assert got == {"1.0.0.0": "AU", "1.0.0.255": "AU", "1.0.1.0": "--", "1.3.9.9": "TH", "1.8.0.0": "--", "-": "--", "::1": "--", None: "--"}


@pytest.mark.parametrize(("code", "flag"), [("de", "\U0001f1e9\U0001f1ea"), ("US", "\U0001f1fa\U0001f1f8"), ("--", ""), ("USA", ""), ("1A", "")])
def test_flag(spark, code, flag):
    assert one(spark, code, enrich.flag) == flag


@pytest.mark.parametrize(("n", "text"), [(0, "0"), (999, "999"), (1000, "1k"), (1234, "1.23k"), (12345, "12.3k"), (99950, "100k"), (999499, "999k"), (999500, "1m"), (1500000, "1.5m"), (2 * 10**9, "2b"), (10**12, "1t"), (5 * 10**15, "5000t")])
def test_compact(spark, n, text):
    assert one(spark, n, fmt.compact, "long") == text


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1048576, "1.0 MB"), (1610612736, "1.50 GB"), (1 << 40, "1.00 TB"), (1 << 50, "1.00 PB")])
def test_byte_size(spark, n, text):
    assert one(spark, n, fmt.byte_size, "long") == text


def test_labels(spark):
    assert one(spark, 404, fmt.status_label, "int") == "Code 404 - Not Found"
    assert one(spark, 418, fmt.status_label, "int") == "Code 418"
    assert one(spark, 0, fmt.status_label, "int") == "Undefined response code"
    assert one(spark, 418, fmt.short_status_label, "int") == "418"
    assert one(spark, 13, fmt.month_name, "int") == "Unknown"
    assert one(spark, "nope", parsing.is_weekend) is False
    assert fmt.use_compact(4) and fmt.use_compact(16)
