"""Structured Streaming: bounded micro-batches of log lines into the store, and early visits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.store import Store
from ..runtime import ship_package
from ..schema import VISIT_SECONDS


#: How long, in the hits' own time, a visitor's state is kept unused: a day, in which late hits still find it.
KEEP_SECONDS = 86_400


def stream_lines(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """(id, value) of new files in a folder; files are complete when they appear."""
    raw = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return raw.select("value")


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, ranges: DataFrame | None = None, files_a_batch: int = 100) -> None:
    """Everything new, once: each micro-batch is one store batch under its own id, so a replay adds nothing.

    Counters carry no watermark: a line of any old date is added to its period. Only the visit state has a
    horizon, which the store prunes.
    """
    lines = stream_lines(spark, folder, files_a_batch)

    def add(batch: DataFrame, batch_id: int) -> None:
        store.add_batch(f"stream-{batch_id}", batch.select(F.monotonically_increasing_id().alias("id"), "value"), ranges)

    lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class VisitStarts(StatefulProcessor):
    """Emits a visitor's hit as soon as it starts a visit; state: the latest time seen, dropped by a timer KEEP_SECONDS later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        """One pass in order of time; only times and ids of a visitor's hits in the micro-batch are held."""
        parts = [(p["ts"].to_numpy(), p["id"].to_numpy()) for p in rows]
        ts, ids = (np.concatenate([p[j] for p in parts]) for j in range(2))
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        seen = self.seen.get()[0] if self.seen.exists() else None
        before = np.concatenate(([ts[0] if seen is None else seen], ts[:-1]))
        if seen is not None:
            before = np.maximum.accumulate(np.maximum(before, seen))
        starts = ts - before > VISIT_SECONDS
        starts[0] |= seen is None
        latest = int(max(ts[-1], before[0]))
        self.seen.update((latest,))
        self.handle.registerTimer((latest + KEEP_SECONDS) * 1000)
        yield pd.DataFrame({"ip": key[0], "id": ids[starts], "ts": ts[starts]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803  (called by these names)
        if self.seen.exists() and (self.seen.get()[0] + KEEP_SECONDS) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        yield pd.DataFrame({"ip": [], "id": [], "ts": []}).astype({"ip": str, "id": "int64", "ts": "int64"})

    def close(self) -> None:
        pass


def visit_starts(hits: DataFrame) -> DataFrame:
    """(ip, id, ts) of hits that start a visit, from a stream of hits; needs the RocksDB state store.

    Hits more than KEEP_SECONDS behind the latest are left out here; the store counts them all the same.
    """
    ship_package(hits.sparkSession)
    timed = hits.select("ip", "id", "ts", F.timestamp_seconds("ts").alias("time")).withWatermark("time", f"{KEEP_SECONDS} seconds")
    return timed.groupBy("ip").transformWithStateInPandas(VisitStarts(), "ip string, id long, ts long", "append", "eventTime")
