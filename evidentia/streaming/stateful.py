"""Per-key state in streams: process keys, snapshot differences.

Each processor keeps one small value per key, updates it row by row in arrival
order and never holds a key's rows longer than the batch that brought them.
Spark partitions the keys and stores the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.asof import EVENT_LOG_TTL

MINUTE_MICROS = 60_000_000

PROCESS_KEY_INPUT = ["ingest_seq", "ts_us", "hint_us", "is_stop", "is_long_lived"]
PROCESS_KEY_OUTPUT = "host string, collection_id string, pid bigint, ingest_seq bigint, create_us bigint, resolution string"
TRANSITION_OUTPUT = "host string, item string, snapshot_id bigint, action string, value string"


def _arrivals(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(frames)
    return pd.concat(parts).sort_values(order) if parts else pd.DataFrame()


class ProcessKeys(StatefulProcessor):
    """Create time of a pid, with the three lifetimes and eviction by Stop or by time.

    An idle pid leaves the state when the watermark has passed its last event by
    the lifetime of its kind: a later event would start a new life anyway, so the
    answers are those of the walk over the whole table. Each life keeps one timer.
    """

    def __init__(self, ttl_minutes: tuple[int, int, int] = EVENT_LOG_TTL):
        provisional, authoritative, long_lived = ttl_minutes
        self.ttl = {
            "provisional": provisional * MINUTE_MICROS,
            "explicit": authoritative * MINUTE_MICROS,
            "long": long_lived * MINUTE_MICROS,
        }

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", "create_us bigint, seen_us bigint, kind string, timer_ms bigint")

    def _leave_at(self, life) -> int:
        """First millisecond at which an event is too late to go on with the life."""
        return (life[1] + self.ttl[life[2]]) // 1000 + 1

    def _keep(self, life, timer: int | None) -> None:
        if life is None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.state.clear()
            return
        due = self._leave_at(life)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((*life, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        host, collection, pid = key
        parts = [[frame[c].to_numpy() for c in PROCESS_KEY_INPUT] for frame in rows]
        columns = parts[0] if len(parts) == 1 else [np.concatenate(values) for values in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        arrivals = [c[order].tolist() for c in columns]
        held = self.state.get()
        life, timer = (held[:3], held[3]) if held is not None else (None, None)
        created, how = [], []
        for now, hint, stop, long_lived in zip(*arrivals[1:], strict=True):
            if hint is not None and hint == hint:
                life, resolution = (int(hint), now, "long" if long_lived else "explicit"), "explicit"
            elif life is not None and now - life[1] <= self.ttl[life[2]]:
                life, resolution = (life[0], now, life[2]), "cached"
            else:
                life, resolution = (now, now, "long" if long_lived else "provisional"), "provisional"
            created.append(life[0])
            how.append(resolution)
            if stop:
                life = None
        self._keep(life, timer)
        yield pd.DataFrame({"host": host, "collection_id": collection, "pid": pid, "ingest_seq": arrivals[0], "create_us": created, "resolution": how})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held is not None and held[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame([], columns=["host", "collection_id", "pid", "ingest_seq", "create_us", "resolution"])

    def close(self) -> None:
        pass


def process_key_stream(stream: DataFrame, ttl_minutes: tuple[int, int, int] = EVENT_LOG_TTL, lateness: str = "1 day") -> DataFrame:
    """Resolve ``host, collection_id, pid, ingest_seq, ts, create_hint, is_stop, is_long_lived`` as it arrives.

    Rows without a pid have no life and are left out; without a collection column
    all rows of a host are one collection. ``lateness`` is the longest
    time by which a row may be older than the newest one before it; Spark leaves
    out older rows, as of every stream with a watermark.
    """
    if "collection_id" not in stream.columns:
        stream = stream.withColumn("collection_id", F.lit(None).cast("string"))
    rows = stream.where("pid is not null").withWatermark("ts", lateness).select(
        "host",
        "collection_id",
        "pid",
        "ingest_seq",
        "ts",
        F.unix_micros("ts").alias("ts_us"),
        F.unix_micros("create_hint").alias("hint_us"),
        "is_stop",
        "is_long_lived",
    )
    return rows.groupBy("host", "collection_id", "pid").transformWithStateInPandas(
        ProcessKeys(ttl_minutes), outputStructType=PROCESS_KEY_OUTPUT, outputMode="append", timeMode="eventTime"
    )


class SnapshotChanges(StatefulProcessor):
    """Appear, change and vanish of one item over numbered snapshots.

    Input carries a row per snapshot in which the item was seen, and a row with
    ``seen`` false for the one after its last. The state is the last snapshot
    number and value.
    """

    def __init__(self, opened: str, changed: str | None, closed: str):
        self.opened, self.changed, self.closed = opened, changed, closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        host, item = key
        frame = _arrivals(rows, ["snapshot_id"])
        last = self.state.get()[0] if self.state.exists() else None
        out = []
        for number, value, seen in zip(frame["snapshot_id"], frame["value"], frame["seen"]):
            if not seen:
                if last is not None:
                    out.append((host, item, number, self.closed, last))
                last = None
            elif last is None:
                out.append((host, item, number, self.opened, value))
                last = value
            elif value != last:
                if self.changed is None:
                    out.append((host, item, number, self.closed, last))
                    out.append((host, item, number, self.opened, value))
                else:
                    out.append((host, item, number, self.changed, value))
                last = value
        if last is None:
            self.state.clear()
        else:
            self.state.update((last,))
        yield pd.DataFrame(out, columns=["host", "item", "snapshot_id", "action", "value"])

    def close(self) -> None:
        pass


def _changes(stream: DataFrame, processor: SnapshotChanges) -> DataFrame:
    rows = stream.select("host", "item", "snapshot_id", "value", "seen")
    return rows.groupBy("host", "item").transformWithStateInPandas(
        processor, outputStructType=TRANSITION_OUTPUT, outputMode="append", timeMode="none"
    )


def connection_state_stream(stream: DataFrame) -> DataFrame:
    """``item`` is the connection identity, ``value`` its state."""
    return _changes(stream, SnapshotChanges("Connect", "Update", "Disconnect"))


def process_state_stream(stream: DataFrame) -> DataFrame:
    """``item`` is the pid, ``value`` its create time; a new create time is a Stop and a Start."""
    return _changes(stream, SnapshotChanges("Start", None, "Stop"))
