"""Settings: a YAML file, overridden by the command line."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

import yaml

from .plans.store import Options

#: File names looked for when none is given.
DEFAULT_FILES = ("logquarry.yml", "logquarry.yaml")


@dataclass(frozen=True)
class Config:
    logs: str = ""
    store: str = "store"
    output: str = "report"
    drop_bots: bool = True
    site_host: str | None = None
    urls: bool = True
    hosts: bool = True
    refs: bool = True
    precision: int = 14
    top_n: int = 20
    geo: str | None = None
    #: Stored bytes of a batch of a run, and of a range that one task reads.
    batch_bytes: int = 256 << 30
    range_bytes: int = 128 << 20

    def options(self) -> Options:
        return Options(self.drop_bots, self.site_host, self.urls, self.hosts, self.refs, self.precision, self.top_n)


PATHS = ("store", "output", "geo")


def load(path: str | None = None, overrides: dict | None = None) -> Config:
    """Unknown keys and a precision outside 4..16 are errors; relative paths start at the file's folder."""
    values: dict = {}
    path = path or next((p for p in DEFAULT_FILES if os.path.exists(p)), None)
    if path:
        with open(path) as f:
            values = yaml.safe_load(f) or {}
        base = os.path.dirname(os.path.abspath(path))
        for k in PATHS:
            if values.get(k):
                values[k] = os.path.join(base, values[k])
        if values.get("logs"):
            values["logs"] = ",".join(os.path.join(base, p.strip()) for p in values["logs"].split(",") if p.strip())
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    config = Config(**(values | {k: v for k, v in (overrides or {}).items() if v is not None}))
    if not 4 <= config.precision <= 16:
        raise ValueError("precision must be from 4 to 16")
    return config
