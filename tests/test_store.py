import gzip
import os

import pytest
from pyspark.sql import functions as F

from logquarry import cli, config, progress
from logquarry.operators import reports
from logquarry.plans.store import Options, Store
from logquarry.reporting import charts, site
from logquarry.streaming import ingest

GEO = [(167772160, 184549375, "DE", "Germany")]


def some_lines(make_line, n=240):
    out = []
    for i in range(n):
        day, month = 1 + i % 28, ("Jan", "Feb")[i // 150]
        out.append(make_line(f"10.0.0.{i % 7}", f"{day:02d}/{month}/2025:{i % 24:02d}:{i % 60:02d}:00 +0000", f"GET /p{i % 9}{('.html', '.js')[i % 2]} HTTP/1.1", (200, 200, 404)[i % 3], i, f"https://r{i % 4}.test/", ("Mozilla/5.0 Firefox/1", "Googlebot/2.1")[i % 11 == 0]))
    return out


def snapshot(store):
    out = {}
    for name in ("hourly", "urls", "hosts", "refs", "agents", "countries", "status", "methods", "protocols"):
        df = store.table(name)
        cols = [c for c in sorted(df.columns) if not (name == "hourly" and c in ("sites", "visits"))]
        out[name] = sorted(map(str, df.select(*cols).collect()))
    out["sites"] = sorted(map(str, store.sites().collect()))
    return out


@pytest.fixture
def geo(spark):
    return spark.createDataFrame(GEO, "first long, last long, country_code string, country_name string")


def test_batches_equal_one_run_and_replay_adds_nothing(spark, tmp_path, lines, make_line, geo):
    texts = some_lines(make_line)
    whole, parts = Store(spark, str(tmp_path / "w")), Store(spark, str(tmp_path / "p"))
    assert whole.add_batch("1", lines(texts), geo)
    assert parts.add_batch("1", lines(texts[:100]), geo) and parts.add_batch("2", lines(texts[100:]), geo)
    assert not parts.add_batch("2", lines(texts[100:]), geo)
    assert snapshot(whole) == snapshot(parts)
    before = snapshot(parts)
    parts.compact(prune=False)
    assert snapshot(parts) == before
    parts.options = Options(top_n=2)
    parts.compact()
    urls = parts.table("urls").where("grain = 'month'").groupBy("period").count().collect()
    assert {r["period"]: r["count"] for r in urls} == {"2025-01": 2, "2025-02": 18}


def test_two_writers(spark, tmp_path, lines, make_line, monkeypatch):
    """Both read the same version; the second to publish applies its change to the first's, and no batch is lost."""
    texts = some_lines(make_line)
    whole, one, two = Store(spark, str(tmp_path / "w")), Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    whole.add_batch("1", lines(texts[:80]))
    whole.add_batch("2", lines(texts[80:]))
    publish, met = Store._publish, []

    def late(store, manifest):
        if store is two and not met:
            met.append(manifest["version"])
            assert one.add_batch("1", lines(texts[:80]))
        return publish(store, manifest)

    monkeypatch.setattr(Store, "_publish", late)
    assert two.add_batch("2", lines(texts[80:]))
    monkeypatch.undo()
    assert sorted(one.manifest()["batches"]) == ["1", "2"] and one.manifest()["version"] == 2 and met == [0]
    for name in ("urls", "agents", "status", "visit_state"):
        assert sorted(map(str, whole.table(name).collect())) == sorted(map(str, one.table(name).select(*whole.table(name).columns).collect())), name
    assert not two.add_batch("1", lines(texts[:80]))


def test_compaction_meets_a_batch_and_vacuum(spark, tmp_path, lines, make_line, monkeypatch):
    texts = some_lines(make_line)
    store = Store(spark, str(tmp_path / "s"))
    store.add_batch("1", lines(texts[:100]))
    publish, met = Store._publish, []

    def late(self, manifest):
        if not met:
            met.append(1)
            Store(spark, store.root).add_batch("2", lines(texts[100:]))
        return publish(self, manifest)

    monkeypatch.setattr(Store, "_publish", late)
    store.compact(prune=False)
    monkeypatch.undo()
    assert store.table("hourly").agg(F.sum("hits")).first()[0] == 240 - 22
    before = {t: sorted(map(str, store.table(t).collect())) for t in ("hourly", "urls", "sketches") if t != "sketches"}
    assert store.vacuum(keep=1, older_than_seconds=3600) == 0
    assert store.vacuum(keep=1, older_than_seconds=-5) > 0
    assert {t: sorted(map(str, store.table(t).collect())) for t in before} == before
    assert len(store._versions()) == 1
    listed = {d for dirs in store.manifest()["tables"].values() for d in dirs}
    assert {f"{t.name}/{d.name}" for t in (tmp_path / "s").iterdir() if t.name != "manifests" for d in t.iterdir()} == listed


def test_unfinished_batch_is_invisible(spark, tmp_path, lines, make_line, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.add_batch("1", lines(some_lines(make_line, 20)))
    monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.add_batch("2", lines(some_lines(make_line, 50)))
    monkeypatch.undo()
    assert reports.totals(store.table("hourly")).first()["hits"] == 18
    assert store.manifest()["batches"] == ["1"]


def test_stream_equals_batch(spark, tmp_path, lines, make_line):
    texts = some_lines(make_line)
    logs = tmp_path / "logs"
    logs.mkdir()
    for k in range(3):
        (logs / f"{k}.log").write_text("".join(t + "\n" for t in texts[80 * k : 80 * k + 80]))
    whole, stream = Store(spark, str(tmp_path / "w")), Store(spark, str(tmp_path / "s"))
    whole.add_batch("1", lines(texts))
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(spark, str(logs), stream, str(tmp_path / "ck"), files_a_batch=1)
    assert len(stream.manifest()["batches"]) == 3
    for name in ("urls", "agents", "status"):
        assert sorted(map(str, whole.table(name).collect())) == sorted(map(str, stream.table(name).select(*whole.table(name).columns).collect()))


def test_visit_starts_in_a_stream(spark, tmp_path):
    folder = tmp_path / "hits"
    rows = [("a", 1, 1000), ("a", 2, 2800), ("a", 3, 4601), ("b", 4, 50)]
    spark.createDataFrame(rows[:2], "ip string, id long, ts long").coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame(rows[2:], "ip string, id long, ts long").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("ip string, id long, ts long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = ingest.visit_starts(stream).writeStream.format("memory").queryName("starts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["ip"], r["id"]) for r in spark.table("starts").collect()} == {("a", 1), ("a", 3), ("b", 4)}


def test_visit_state_expires_in_a_stream(spark, tmp_path):
    """Visitors a week apart: each one's state goes once the hits' time has passed it by a day."""
    folder, day = tmp_path / "hits", 86_400
    for k in range(5):
        spark.createDataFrame([(f"v{k}{i}", 10 * k + i, 7 * day * (k + 1) + i) for i in range(6)], "ip string, id long, ts long").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("ip string, id long, ts long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = ingest.visit_starts(stream).writeStream.format("memory").queryName("weekly").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    assert spark.table("weekly").count() == 30
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 30


def test_command_line(spark, tmp_path, make_line):
    texts = some_lines(make_line)
    (tmp_path / "a.log").write_text("".join(t + "\n" for t in texts[:200]) + "broken\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("".join(t + "\n" for t in texts[200:]))
    (tmp_path / "logquarry.yml").write_text("logs: '*.log,*.gz'\nstore: st\noutput: out\nsite_host: r1.test\n")
    cfg = config.load(str(tmp_path / "logquarry.yml"), {"top_n": 5})
    assert cfg.top_n == 5 and cfg.store == str(tmp_path / "st") and cfg.options().capacity == 500
    assert cli.process(spark, cfg) == 240
    assert cli.process(spark, cfg) == 0
    with open(tmp_path / "a.log", "a") as f:
        f.write(make_line(time="03/Mar/2026:00:00:00 +0000") + "\n")
    assert cli.process(spark, cfg) == 1
    store = Store(spark, cfg.store, cfg.options())
    assert reports.totals(store.table("hourly")).first()["hits"] == 240 - 22 + 1
    pages = {os.path.relpath(p, cfg.output) for p in site.generate(store, cfg.output)}
    assert pages == {"index.html", "2025/index.html", "2026/index.html", "2025-01/index.html", "2025-02/index.html", "2026-03/index.html"}
    assert "r1.test" not in (tmp_path / "out/2025-01/index.html").read_text()


def test_run_in_parts_and_after_a_crash(spark, tmp_path, make_line, monkeypatch):
    """Two large files over many batches; a run that dies keeps what it had published, and the next reads the rest."""
    texts = [make_line(f"10.0.0.{i % 9}", f"01/Jan/2025:{i // 250:02d}:{i // 60 % 60:02d}:{i % 60:02d} +0000", f"GET /p{i} HTTP/1.1") for i in range(6000)]
    (tmp_path / "a.log").write_text("".join(t + "\n" for t in texts[:3000]))
    (tmp_path / "b.log").write_text("".join(t + "\n" for t in texts[3000:]) + "un")
    cfg = config.load(None, {"logs": f"{tmp_path}/*.log", "store": str(tmp_path / "st"), "batch_bytes": 260_000, "range_bytes": 45_000})
    plans = cli.ledger.plan(cli.files.expand_globs(cfg.logs), [])
    parts = cli.parts_of(plans, cfg.batch_bytes, cfg.range_bytes)
    assert len(parts) >= 3 and sum(len(p.ranges) for p in parts) > 10 and not any(p.whole for p in parts)
    add, calls = Store.add_batch, []

    def dies(self, *args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return add(self, *args)

    monkeypatch.setattr(Store, "add_batch", dies)
    with pytest.raises(RuntimeError):
        cli.process(spark, cfg)
    monkeypatch.undo()
    store = Store(spark, cfg.store)
    first = reports.totals(store.table("hourly")).first()["hits"]
    left = [e for e in store.manifest()["ledger"] if not e["completed"]]
    assert 0 < first < 6000 and len(left) == 1 and left[0]["done"] > 0
    assert cli.process(spark, cfg) == 6000 - first
    assert reports.totals(store.table("hourly")).first()["hits"] == 6000 and cli.process(spark, cfg) == 0
    assert all(e["completed"] for e in store.manifest()["ledger"] if not e["retired"])
    with open(tmp_path / "b.log", "a") as f:
        f.write("ended\n" + texts[0] + "\n")
    assert cli.process(spark, cfg) == 1


def test_pages_are_drawn_and_formatted(spark, tmp_path, lines, make_line, geo):
    store = Store(spark, str(tmp_path / "s"))
    many = [make_line(f"10.0.0.{i % 7}", f"{1 + i % 28:02d}/Jan/2025:{i % 24:02d}:00:00 +0000", f"GET /p{i % 3} HTTP/1.1", 200 + i % 40, 5_000_000) for i in range(1200)]
    store.add_batch("1", lines(many), geo)
    site.generate(store, str(tmp_path / "out"))
    month = (tmp_path / "out/2025-01/index.html").read_text()
    assert month.count("<svg") >= 6 and "<td>1,200</td>" in month and "5.59 GB" in month
    for part in ("Daily averages", "Hourly averages", "Hours", "Other (", "Daily Activity"):
        assert part in month, part
    assert all(f"<td>{200 + k}</td>" in month for k in range(40))  # every code, not the first of them only


def test_countries_of_both_kinds(spark):
    from logquarry.functions import enrich

    ranges = spark.createDataFrame([("10.0.0.0", "10.0.255.255", "DE", "Germany"), ("2001:db8::", "2001:db8:0:ffff:ffff:ffff:ffff:ffff", "NL", "Netherlands"), ("2001:db8:8000::", "2001:dc0::", "SE", "Sweden")], "first string, last string, country_code string, country_name string")
    ips = {"10.0.3.4": "DE", "010.0.0.0": "DE", "10.1.0.0": "--", "2001:DB8::1": "NL", "2001:db8:1::": "--", "2001:db8:0:ffff::9": "NL", "2001:dbf:ffff::": "SE", "2001:dc0::": "SE", "2001:dc0::1": "--", "::1": "--", "name": "--", "": "--", None: "--"}
    got = enrich.with_country(spark.createDataFrame([(i,) for i in ips], "ip string"), ranges).collect()
    assert {r["ip"]: r["country_code"] for r in got} == ips
    assert enrich.with_country(spark.createDataFrame([("1.2.3.4",)], "ip string"), ranges.limit(0)).first()["country_name"] == "Unknown"


def test_no_data_writes_assets_only(spark, tmp_path):
    assert site.generate(Store(spark, str(tmp_path / "s")), str(tmp_path / "out")) == []
    assert os.path.exists(tmp_path / "out/assets/style.css")


def test_config_errors(tmp_path):
    (tmp_path / "c.yml").write_text("nope: 1\n")
    with pytest.raises(ValueError, match="nope"):
        config.load(str(tmp_path / "c.yml"))
    with pytest.raises(ValueError, match="precision"):
        config.load(None, {"precision": 3})


def test_progress_texts():
    assert progress.short_count(999) == "999" and progress.short_count(1500) == "1.5k"
    assert progress.rate(3000, 2) == "1.5k l/s" and progress.rate(1, 0) == "0 l/s"
    assert progress.clock(65) == "01:05" and progress.clock(3700) == "1:01:40"
    assert progress.eta(50, 100, 10) == "00:10" and progress.eta(0, 100, 10) == "--:--"


def test_chart_shares():
    import json

    spec = json.loads(charts.status([{"status": s, "hits": h} for s, h in ((200, 50), (404, 20), (500, 10), (302, 10), (0, 5), (999, 5))]))
    assert spec["data"]["labels"] == ["200 OK (50.0%)", "404 Not Found (20.0%)", "500 Server Error (10.0%)", "302 Found (10.0%)", "Unknown (5.0%)", "Other (5.0%)"]
    assert spec["data"]["datasets"][0]["backgroundColor"][:2] == ["#52c493", "#ffc055"]
    assert charts.percent(1, 0) == 0.0 and charts.half_up(0.125, 2) == 0.13


@pytest.mark.parametrize("n", [0, 7, 999, 1000, 1023, 1024, 1234, 9994, 9995, 99_949, 99_950, 999_499, 999_500, 999_999, 1_048_576, 1_500_000, 10**9, 10**12 - 1, 5 * 10**15, 2**55])
def test_texts_equal_columns(spark, n):
    from logquarry.functions import fmt

    r = spark.createDataFrame([(n,)], "n long").select(fmt.compact(F.col("n")).alias("c"), fmt.byte_size(F.col("n")).alias("b")).first()
    assert (fmt.compact_text(n), fmt.byte_text(n)) == (r["c"], r["b"])


def test_formatted_rows(spark):
    r = site.formatted(spark.createDataFrame([(1234, 2048)], "hits long, bandwidth long")).first()
    assert (r["hits_text"], r["bandwidth_text"]) == ("1.23k", "2.0 KB")
    assert F is not None
