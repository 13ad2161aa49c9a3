"""Texts of the progress line."""

from __future__ import annotations


def short_count(n: float) -> str:
    for limit, unit in ((1e9, "G"), (1e6, "M"), (1e3, "k")):
        if n >= limit:
            return f"{n / limit:.1f}{unit}"
    return f"{n:.0f}"


def rate(lines: int, seconds: float) -> str:
    return f"{short_count(lines / seconds if seconds > 0 else 0)} l/s"


def clock(seconds: float) -> str:
    s = max(0, int(seconds))
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60:02d}:{s % 60:02d}"


def eta(done: int, total: int, seconds: float) -> str:
    return "--:--" if done <= 0 or total <= 0 else clock(seconds * max(total - done, 0) / done)
