"""Static report pages from the store: index, one page a year, one a month.

All periods' rows come from a handful of queries (one per table, limited per period by rank); only those small
results reach the driver, which writes the files.
"""

from __future__ import annotations

import html
import os
from collections import defaultdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import reports, topk
from ..plans.store import Store
from ..schema import MONTH_NAMES
from . import charts

STYLE = "figure{margin:1em 0}svg{max-width:720px;font-size:10px}.legend{list-style:none;padding:0;display:flex;flex-wrap:wrap;gap:8px}.legend i{display:inline-block;width:10px;height:10px;margin-right:4px}body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:2px 8px;text-align:right;border-bottom:1px solid #ddd}td:first-child,th:first-child{text-align:left}\n"


#: Share charts: table (and drawing), key, keys shown by name.
SHARES = (("status", "status", 5), ("countries", "country_code", 9), ("agents", "family", 9))


def _page(title: str, body: str) -> str:
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><link rel="stylesheet" href="/assets/style.css"></head><body><h1>{html.escape(title)}</h1>{body}<p>Generated {stamp}</p></body></html>'


def _text(column: str, value, compact_sites: bool) -> str:
    """A cell: sizes in units, counts with thousands marked, estimated visitors with three figures if they are not exact."""
    if column.split("_")[-1] == "bandwidth":
        return fmt.byte_text(int(value))
    if column == "status":
        return str(value)
    if column == "sites" and compact_sites:
        return fmt.compact_text(int(value))
    return f"{value:,}" if isinstance(value, int) else str(value)


def _table(title: str, rows: list[dict], columns: list[str], compact_sites: bool = False) -> str:
    if not rows:
        return ""  # empty sections are left out
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_text(c, r.get(c, ''), compact_sites))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def _chart(name: str, spec: str) -> str:
    """Drawn, and as JSON for other programs."""
    return charts.svg(spec) + f'<script type="application/json" class="chart" id="{name}">{spec.replace("</", "<\\/")}</script>'


def _rows(df: DataFrame | None, *order: str) -> list[dict]:
    return [] if df is None else [r.asDict() for r in df.orderBy(*order).collect()]


def _by_period(df: DataFrame | None, key: str, n: int | None, *metrics: str) -> dict[str, list[dict]]:
    """Each period's rows, best first; all of them without n (codes, methods and protocols are few by their nature)."""
    out: dict[str, list[dict]] = defaultdict(list)
    if df is not None:
        ranked = df if n is None else topk.top_per_period(df, key, n, *metrics)
        for r in _rows(ranked, "period", *(F.desc(m) for m in metrics), key):
            out[r["period"]].append(r)
    return out


def _shares(df: DataFrame | None, key: str, n: int) -> dict[str, list[dict]]:
    """Each period's n most frequent keys and one row Other: what a share chart draws, whatever the number of keys."""
    out: dict[str, list[dict]] = defaultdict(list)
    if df is not None:
        for r in _rows(topk.head_and_other(df, key, n), "period", "position"):
            out[r["period"]].append({key: r["label"], "hits": r["hits"], "rest": r["position"] > n})
    return out


def generate(store: Store, out_dir: str) -> list[str]:
    """Writes the pages; returns their paths. Without data only the assets are written."""
    os.makedirs(f"{out_dir}/assets", exist_ok=True)
    with open(f"{out_dir}/assets/style.css", "w") as f:
        f.write(STYLE)
    hourly = store.table("hourly")
    if hourly is None or hourly.isEmpty():
        return []
    n, few = store.options.top_n, fmt.use_compact(store.options.precision)
    hourly = hourly.persist()
    sites = {r["period"]: r["sites"] for r in _rows(store.sites(), "period")}
    days, months, years = (_rows(df, k) for df, k in ((reports.daily(hourly), "date"), (reports.months(hourly), "month"), (reports.years(hourly), "year")))
    hours = _rows(hourly.groupBy(F.substring("date", 1, 7).alias("month"), "hour").agg(*[F.sum(c).alias(c) for c in ("hits", "pages", "files", "bandwidth", "visits")]), "month", "hour")
    ranked = {
        "Top URLs by hits": (_by_period(store.table("urls"), "url", n, "hits", "bandwidth"), ["url", "hits", "bandwidth"]),
        "Top URLs by bandwidth": (_by_period(store.table("urls"), "url", n, "bandwidth", "hits"), ["url", "hits", "bandwidth"]),
        "Top sites by hits": (_by_period(store.table("hosts"), "ip", n, "hits", "bandwidth"), ["ip", "country_code", "hits", "bandwidth"]),
        "Top sites by bandwidth": (_by_period(store.table("hosts"), "ip", n, "bandwidth", "hits"), ["ip", "country_code", "hits", "bandwidth"]),
        "Top referrers": (_by_period(store.table("refs"), "ref_host", n, "hits"), ["ref_host", "hits"]),
        "Browsers": (_by_period(store.table("agents"), "family", n, "hits"), ["family", "hits"]),
        "Countries": (_by_period(store.table("countries"), "country_code", n, "hits"), ["country_code", "hits"]),
        "Status codes": (_by_period(store.table("status"), "status", None, "hits"), ["status", "hits"]),
        "Methods": (_by_period(store.table("methods"), "method", None, "hits"), ["method", "hits"]),
        "Protocols": (_by_period(store.table("protocols"), "proto", None, "hits"), ["proto", "hits"]),
    }
    averages = {p: (reports.daily_averages(hourly, p).first().asDict(), reports.hourly_averages(hourly, p).first().asDict()) for p in (m["month"] for m in months)}
    shares = {t: _shares(store.table(t), k, n) for t, k, n in SHARES}
    hourly.unpersist()
    written = []

    def save(path: str, title: str, body: str) -> None:
        full = os.path.join(out_dir, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(_page(title, body))
        written.append(full)

    columns = ["hits", "files", "pages", "visits", "sites", "bandwidth"]
    for rows, key in ((days, "date"), (months, "month"), (years, "year")):
        for r in rows:
            r["sites"] = sites.get(r[key], r.get("sites", 0))

    def sections(period: str, skip: tuple[str, ...] = ()) -> str:
        out = "".join(_table(t, rows[period], cols) for t, (rows, cols) in ranked.items() if t not in skip)
        return out + "".join(_chart(t, getattr(charts, t)(shares[t][period])) for t, _, _ in SHARES if shares[t][period])

    def averaged(month: str) -> str:
        day, hour = averages[month]
        names = ("hits", "files", "pages", "visits", "sites", "bandwidth")
        rows = [{"per day": c, "average": _text(c, day[f"avg_{c}"], False), "maximum": _text(c, day[f"max_{c}"], False)} for c in names]
        return _table("Daily averages", rows, ["per day", "average", "maximum"]) + _table("Hourly averages", [{"per hour": "hits", "average": hour["avg_hits"], "maximum": hour["max_hits"]}], ["per hour", "average", "maximum"])

    for r in months:
        month, own = r["month"], [d for d in days if d["date"].startswith(r["month"])]
        seen = {h["hour"]: h for h in hours if h["month"] == month}
        dense = [seen.get(i) or dict.fromkeys(("hits", "pages", "files", "bandwidth", "visits"), 0) | {"hour": i} for i in range(24)]
        body = _table("Totals", [r], ["month", *columns], few) + averaged(month) + _table("Days", own, ["date", *columns], few) + _table("Hours", dense, ["hour", "hits", "files", "pages", "visits", "bandwidth"]) + sections(month)
        body += _chart("daily", charts.daily(own)) + _chart("daily-visits", charts.daily_visits(own)) + _chart("hourly", charts.hourly(dense))
        save(f"{month}/index.html", f"{MONTH_NAMES[int(month[5:7]) - 1]} {month[:4]}", body)
    for r in years:
        own = [m for m in months if m["month"].startswith(r["year"])]
        labels = [MONTH_NAMES[int(m["month"][5:7]) - 1][:3] for m in own]
        body = _table("Totals", [r], ["year", *columns], few) + _table("Months", own, ["month", *columns], few) + sections(r["year"], ("Top referrers",))
        body += _chart("months", charts.activity("Monthly Overview", labels, own)) + _chart("visits", charts.visit_bars(labels, own))
        save(f"{r['year']}/index.html", f"Year {r['year']}", body)
    labels = [y["year"] for y in years]
    links = "".join(f'<li><a href="{y["year"]}/index.html">{y["year"]}</a></li>' for y in reversed(years)) + "".join(f'<li><a href="{m["month"]}/index.html">{m["month"]}</a></li>' for m in reversed(months))
    total = [{c: sum(y[c] for y in years) for c in columns if c != "sites"} | {"sites": sites.get("__all__", 0), "all": "all"}]
    body = _table("Totals", total, ["all", *columns], few) + _table("Years", years, ["year", *columns], few) + f"<ul>{links}</ul>"
    body += _chart("years", charts.activity("Yearly Overview", labels, years)) + _chart("visits", charts.visit_bars(labels, years))
    for table, key, most in SHARES:
        counts = store.table(table)
        if counts is not None:
            whole = reports.all_time(counts, key).select(F.lit("all").alias("grain"), F.lit("__all__").alias("period"), key, "hits")
            rows = _shares(whole, key, most)["__all__"]
            body += _chart(table, getattr(charts, table)(rows)) if rows else ""
    save("index.html", "Access statistics", body)
    return written



def formatted(rows: DataFrame) -> DataFrame:
    """Adds the shown text of hits and bandwidth to report rows."""
    return rows.withColumn("hits_text", fmt.compact(F.col("hits"))).withColumn("bandwidth_text", fmt.byte_size(F.col("bandwidth")))
