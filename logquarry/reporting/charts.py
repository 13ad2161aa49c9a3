"""Charts from small report rows on the driver: JSON (type, data, options) for other programs, and drawn as SVG."""

from __future__ import annotations

import html
import json
import math
from decimal import ROUND_HALF_UP, Decimal

from ..schema import OTHER_COLOUR, PALETTE, SHORT_STATUS_LABELS, STATUS_COLOURS, STATUS_ZERO_SHORT

# Dataset label, row field, palette index; titles and labels below likewise.
ACTIVITY = (("Hits", "hits", 0), ("Pages", "pages", 1), ("Files", "files", 4))
VISITS = (("Visits", "visits", 5), ("Sites", "sites", 3))


def half_up(x: float, digits: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def percent(value: int, total: int) -> float:
    return half_up(value / total * 100, 1) if total > 0 else 0.0


def _options(title: str, **more) -> dict:
    return {"title": title} | more


def _bars(labels: list[str], rows: list[dict], sets, axis: dict) -> list[dict]:
    return [{"label": name, "data": [r[f] for r in rows], "backgroundColor": PALETTE[i]} | axis for name, f, i in sets]


def activity(title: str, labels: list[str], rows: list[dict]) -> str:
    """Bars of hits, pages and files with a bandwidth line on a second axis."""
    line = {"label": "Bandwidth (MB)", "data": [half_up(r["bandwidth"] / 1048576, 2) for r in rows], "backgroundColor": PALETTE[2], "yAxisID": "y1", "type": "line"}
    return json.dumps({"type": "bar", "data": {"labels": labels, "datasets": [*_bars(labels, rows, ACTIVITY, {"yAxisID": "y"}), line]}, "options": _options(title, axes={"y": "Count", "y1": "MB"})})


def visit_bars(labels: list[str], rows: list[dict]) -> str:
    return json.dumps({"type": "bar", "data": {"labels": labels, "datasets": _bars(labels, rows, VISITS, {"yAxisID": "y"})}, "options": _options("Visits & Sites", axes={"y": "Count"})})


def daily(rows: list[dict]) -> str:
    return activity("Daily Activity", [r["date"].rsplit("-", 1)[-1] for r in rows], rows)


def daily_visits(rows: list[dict]) -> str:
    return visit_bars([r["date"].rsplit("-", 1)[-1] for r in rows], rows)


def hourly(rows: list[dict]) -> str:
    return activity("Hourly Distribution", [f"{r['hour']:02d}:00" for r in rows], rows)


def _doughnut(title: str, parts: list[tuple[str, int, str]]) -> str:
    total = sum(n for _, n, _ in parts)
    data = {"labels": [f"{name} ({percent(n, total):.1f}%)" for name, n, _ in parts], "datasets": [{"data": [n for _, n, _ in parts], "backgroundColor": [c for _, _, c in parts]}]}
    return json.dumps({"type": "doughnut", "data": data, "options": _options(title)}, ensure_ascii=False)


def _head(rows: list[dict], n: int) -> tuple[list[dict], int]:
    """(the n most frequent, hits of the rest); rows may hold the rest summed already, marked so."""
    order = sorted((r for r in rows if not r.get("rest")), key=lambda r: -r["hits"])
    return order[:n], sum(r["hits"] for r in order[n:]) + sum(r["hits"] for r in rows if r.get("rest"))


def status(rows: list[dict]) -> str:
    """The five most frequent codes and the rest."""
    head, rest = _head(rows, 5)
    parts = []
    for i, r in enumerate(head):
        code = int(r["status"])
        label = STATUS_ZERO_SHORT if code == 0 else SHORT_STATUS_LABELS.get(code, str(code))
        parts.append((label, r["hits"], STATUS_COLOURS.get(code // 100, PALETTE[i % len(PALETTE)])))
    return _doughnut("HTTP Status Codes", parts + [("Other", rest, OTHER_COLOUR)] * (rest > 0))


def _shares(title: str, key: str, rows: list[dict]) -> str:
    head, rest = _head(rows, 9)
    named = [(r[key], r["hits"]) for r in head] + [("Other", rest)] * (rest > 0)
    return _doughnut(title, [(name, n, PALETTE[i % len(PALETTE)]) for i, (name, n) in enumerate(named)])


def countries(rows: list[dict]) -> str:
    return _shares("Top Countries", "country_code", rows)


def agents(rows: list[dict]) -> str:
    return _shares("Browser Families", "family", rows)


WIDTH, HEIGHT, EDGE = 720, 240, 28


def svg(spec: str) -> str:
    """A chart's specification drawn: bars with lines over them, or a ring with its legend."""
    chart = json.loads(spec)
    draw = _ring if chart["type"] == "doughnut" else _columns
    title = html.escape(chart["options"]["title"])
    return f'<figure><figcaption>{title}</figcaption><svg viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-label="{title}">{draw(chart["data"])}</svg>{_legend(chart["data"])}</figure>'


def _legend(data: dict) -> str:
    sets = data["datasets"]
    ring = isinstance(sets[0]["backgroundColor"], list) if sets else False
    names = zip(data["labels"], sets[0]["backgroundColor"], strict=True) if ring else ((s["label"], s["backgroundColor"]) for s in sets)
    return '<ul class="legend">' + "".join(f'<li><i style="background:{c}"></i>{html.escape(str(n))}</li>' for n, c in names) + "</ul>"


def _columns(data: dict) -> str:
    labels, sets = data["labels"], data["datasets"]
    bars, lines = ([s for s in sets if (s.get("type") == "line") is line] for line in (False, True))
    step = (WIDTH - 2 * EDGE) / max(len(labels), 1)
    tall = HEIGHT - 2 * EDGE
    most = max((v for s in bars for v in s["data"]), default=0) or 1
    width = step * 0.8 / max(len(bars), 1)
    out = []
    for k, s in enumerate(bars):
        for i, v in enumerate(s["data"]):
            h = tall * v / most
            out.append(f'<rect x="{EDGE + i * step + step * 0.1 + k * width:.1f}" y="{HEIGHT - EDGE - h:.1f}" width="{width:.1f}" height="{h:.1f}" fill="{s["backgroundColor"]}"><title>{html.escape(f"{labels[i]} {s['label']}: {v:,}")}</title></rect>')
    for s in lines:
        top = max(s["data"], default=0) or 1
        points = " ".join(f"{EDGE + (i + 0.5) * step:.1f},{HEIGHT - EDGE - tall * v / top:.1f}" for i, v in enumerate(s["data"]))
        out.append(f'<polyline points="{points}" fill="none" stroke="{s["backgroundColor"]}"/><text x="{WIDTH - EDGE}" y="{EDGE - 8}" text-anchor="end">{top:,}</text>')
    every = max(1, len(labels) // 16)
    out += [f'<text x="{EDGE + (i + 0.5) * step:.1f}" y="{HEIGHT - 10}" text-anchor="middle">{html.escape(str(x))}</text>' for i, x in enumerate(labels) if i % every == 0]
    return "".join(out) + f'<text x="{EDGE}" y="{EDGE - 8}">{most:,}</text><line x1="{EDGE}" y1="{HEIGHT - EDGE}" x2="{WIDTH - EDGE}" y2="{HEIGHT - EDGE}" stroke="currentColor"/>'


def _ring(data: dict) -> str:
    values, colours = data["datasets"][0]["data"], data["datasets"][0]["backgroundColor"]
    total, at, radius, out = sum(values) or 1, 0.0, 80, []
    around = 2 * math.pi * radius
    for label, v, c in zip(data["labels"], values, colours, strict=True):
        part = around * v / total
        out.append(f'<circle cx="{WIDTH / 2}" cy="{HEIGHT / 2}" r="{radius}" fill="none" stroke="{c}" stroke-width="40" stroke-dasharray="{part:.2f} {around - part:.2f}" stroke-dashoffset="{-at:.2f}"><title>{html.escape(label)}: {v:,}</title></circle>')
        at += part
    return "".join(out)
