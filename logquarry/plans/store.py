"""The rollup store: append-only partial aggregates under one manifest.

Every batch writes its partial aggregates to a directory of its own in each table, and then publishes one new
manifest that lists the live directories; readers go by the newest manifest, so a batch is visible in all tables or
in none, and one already listed is not added again. A manifest's file is named by its version and never replaced: of
two writers that read the same version one publishes the next, and the other reads it and applies its change anew.
Reading sums the partials; compaction rewrites them, and only there rankings are pruned, since a dropped row could
not be added to later. Vacuum deletes what no kept manifest lists.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enrich
from ..operators import hits as hits_ops
from ..operators import rollup, sketch, topk, visits
from ..schema import COUNTERS

#: table: (keys, sums)
COUNTS = {
    "hourly": (["date", "hour"], [*COUNTERS, "sites"]),
    "urls": (["grain", "period", "url"], ["hits", "bandwidth"]),
    "refs": (["grain", "period", "ref_host"], ["hits"]),
    "agents": (["grain", "period", "family"], ["hits"]),
    "countries": (["grain", "period", "country_code"], ["hits"]),
    "status": (["grain", "period", "status"], ["hits"]),
    "methods": (["grain", "period", "method"], ["hits"]),
    "protocols": (["grain", "period", "proto"], ["hits"]),
}
#: Ranked tables that compaction prunes: key and order.
RANKED = {"urls": ("url", ("hits", "bandwidth")), "refs": ("ref_host", ("hits",)), "agents": ("family", ("hits",)), "countries": ("country_code", ("hits",)), "hosts": ("ip", ("hits", "bandwidth"))}


@dataclass(frozen=True)
class Options:
    drop_bots: bool = True
    site_host: str | None = None
    urls: bool = True
    hosts: bool = True
    refs: bool = True
    precision: int = 14
    top_n: int = 20

    @property
    def capacity(self) -> int:
        """Rows that the latest periods keep."""
        return max(1, self.top_n * 100)

    def tables(self, countries: bool) -> list[str]:
        """The tables that a batch adds to."""
        switched = {"urls": self.urls, "refs": self.refs, "countries": countries, "country_names": countries, "hosts": countries and self.hosts}
        return ["hourly", "agents", "status", "methods", "protocols", "sketches", *(t for t, on in switched.items() if on)]


@dataclass
class Store:
    spark: SparkSession
    root: str
    options: Options = field(default_factory=Options)

    # Manifests go through Hadoop's file systems, as the tables do: written aside, then renamed to a name that must be
    # new. An object store without an atomic rename needs its conditional put instead.

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return {"version": 0, "batches": [], "tables": {}, "ledger": []}
        stream = self._fs().open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Writes the manifest as the version after its own; False if another writer was first."""
        conf, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm
        following = manifest | {"version": manifest["version"] + 1}
        draft, path = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/{following['version']:012d}.json")
        out = self._fs().create(draft)
        out.write(bytearray(json.dumps(following).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(draft, path, how)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _change(self, change: Callable[[dict], bool]) -> bool:
        """Applies a change to the newest manifest and publishes it, again from the newest whenever another writer was first."""
        while True:
            manifest = self.manifest()
            if not change(manifest):
                return False
            if self._publish(manifest):
                return True

    def _parts(self, table: str, manifest: dict | None = None) -> DataFrame | None:
        dirs = (manifest or self.manifest())["tables"].get(table, [])
        return self.spark.read.parquet(*[f"{self.root}/{d}" for d in dirs]) if dirs else None

    def table(self, name: str, manifest: dict | None = None) -> DataFrame | None:
        """A table as of the manifest (the newest, if none is given), partials merged; None before the first batch."""
        parts = self._parts(name, manifest)
        if parts is None:
            return None
        if name in COUNTS:
            keys, sums = COUNTS[name]
            return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        if name == "hosts":
            known = F.max(F.when(F.col("country_code") != "--", F.col("country_code")))
            return parts.groupBy("grain", "period", "ip").agg(F.sum("hits").alias("hits"), F.sum("bandwidth").alias("bandwidth"), F.coalesce(known, F.lit("--")).alias("country_code"))
        if name == "sketches":
            return parts.groupBy("date").agg(F.hll_union_agg("sketch").alias("sketch"))
        if name == "visit_state":
            return parts.groupBy("ip").agg(F.max("last_seen").alias("last_seen"))
        if name == "country_names":
            return rollup.country_names(parts)
        raise KeyError(name)

    def sites(self) -> DataFrame | None:
        """(grain, period, sites) estimated from the day sketches."""
        days = self.table("sketches")
        return None if days is None else sketch.estimates(sketch.scope_sketches(days)).select("grain", "period", "sites")

    def partials(self, hits: DataFrame, ranges: DataFrame | None, base: dict | None = None) -> dict[str, DataFrame]:
        """What a batch of persisted hits adds to each table; countries are joined to addresses, not to hits."""
        o = self.options
        located = enrich.with_country(rollup.address_counts(hits), ranges) if ranges is not None else None
        every = {
            "hourly": lambda: rollup.hourly_of(hits, self.table("visit_state", base)), "agents": lambda: rollup.agent_counts(hits), "status": lambda: rollup.status_counts(hits),
            "methods": lambda: rollup.method_counts(hits), "protocols": lambda: rollup.protocol_counts(hits), "sketches": lambda: sketch.day_sketches(hits, o.precision),
            "urls": lambda: rollup.url_counts(hits), "refs": lambda: rollup.referrer_counts(hits, o.site_host), "countries": lambda: rollup.country_counts(located),
            "country_names": lambda: located.select("country_code", "country_name").distinct(), "hosts": lambda: rollup.host_counts(located),
        }
        return {t: every[t]() for t in o.tables(located is not None)}

    def add_batch(self, batch_id: str, lines: DataFrame, ranges: DataFrame | None = None, ledger: list | None = None) -> bool:
        """Adds a batch of raw lines to every table; False if the manifest lists it already."""
        base = self.manifest()
        if batch_id in base["batches"]:
            return False
        hits = hits_ops.hits(lines, self.options.drop_bots).persist()
        try:
            written = {name: self._write(name, df) for name, df in self.partials(hits, ranges, base).items()}
            state = self._write("visit_state", visits.prune_state(visits.visit_state(hits, self.table("visit_state", base))))
        finally:
            hits.unpersist()

        def add(manifest: dict) -> bool:
            if batch_id in manifest["batches"]:
                return False
            for name, path in written.items():
                manifest["tables"].setdefault(name, []).append(path)
            seen = [d for d in manifest["tables"].get("visit_state", []) if d not in base["tables"].get("visit_state", [])]
            manifest["tables"]["visit_state"] = [*seen, state]  # beside that of another writer: of several, the latest time counts
            manifest["batches"].append(batch_id)
            if ledger is not None:
                manifest["ledger"] = ledger
            return True

        return self._change(add)

    def _write(self, table: str, df: DataFrame) -> str:
        path = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return path

    def compact(self, prune: bool = True) -> None:
        """Rewrites every table as one directory, rankings pruned; batches that come meanwhile stay listed beside it."""
        base, o = self.manifest(), self.options
        before, tables = base["tables"], {}
        for name in before:
            df = self.table(name, base)
            if prune and name in RANKED:
                key, metrics = RANKED[name]
                df = topk.prune(df, key, o.top_n, o.capacity if name == "urls" else None, *metrics)
            if name == "visit_state":
                df = visits.prune_state(df)
            tables[name] = self._write(name, df)

        def replace(manifest: dict) -> bool:
            if any(set(before[name]) - set(manifest["tables"].get(name, [])) for name in before):
                return False  # another compaction was first
            for name, path in tables.items():
                manifest["tables"][name] = [path, *(d for d in manifest["tables"][name] if d not in before[name])]
            return True

        self._change(replace)

    def vacuum(self, keep: int = 2, older_than_seconds: float = 86_400) -> int:
        """Deletes the directories that none of the newest `keep` manifests lists, and the manifests before those.

        Only what is older than the given time goes: a younger directory may be of a batch that is about to be published,
        or still be read. Returns the number of directories deleted.
        """
        versions = self._versions()
        listed = {d for v in versions[-keep:] for dirs in self.manifest(v)["tables"].values() for d in dirs}
        fs, limit, gone = self._fs(), (time.time() - older_than_seconds) * 1000, 0
        for table in (*COUNTS, "hosts", "sketches", "visit_state", "country_names"):
            if not fs.exists(self._path(table)):
                continue
            for f in fs.listStatus(self._path(table)):
                if f"{table}/{f.getPath().getName()}" not in listed and f.getModificationTime() <= limit:
                    gone += bool(fs.delete(f.getPath(), True))
        for v in versions[:-keep]:
            path = self._path(f"manifests/{v:012d}.json")
            if fs.getFileStatus(path).getModificationTime() <= limit:
                fs.delete(path, False)
        return gone
