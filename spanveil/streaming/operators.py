"""Structured Streaming operators: deduplication, windows, and stateful rings and watchdogs (approvals have their own module)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Each key once; its state goes with the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, by: list[str], ts: str = "ts", width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums of a value by time window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, lateness).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, by: list[str], ts: str = "ts", gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts by session of each key."""
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


class Watchdog(StatefulProcessor):
    """Latches a key once ``threshold`` suspicious steps fall in the last ``window`` steps; later events of it are reported as halted."""

    def __init__(self, window: int = 8, threshold: int = 3, kinds: tuple[str, ...] = ("error",)) -> None:
        self.window, self.threshold, self.kinds = window, threshold, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "steps array<long>, halted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, halted = self.state.get() if self.state.exists() else ([], False)
        steps = list(steps)
        out = []
        for r in pd.concat(list(rows)).sort_values("step").itertuples(index=False):  # the whole batch, not each Arrow chunk, in order
            if r.kind in self.kinds:
                steps.append(int(r.step))
            steps = [s for s in steps if s > r.step - self.window]
            halted = bool(halted or len(steps) >= self.threshold)
            out.append((key[0], int(r.step), len(steps), halted))
        self.state.update((steps, halted))
        yield pd.DataFrame(out, columns=["key", "step", "suspicious", "halted"])

    def close(self) -> None:
        pass


def watchdog(events: DataFrame, window: int = 8, threshold: int = 3, kinds: tuple[str, ...] = ("error",)) -> DataFrame:
    """events (key, step, kind) with the latch of each key."""
    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").transformWithStateInPandas(Watchdog(window, threshold, kinds), f"key {kind}, step long, suspicious int, halted boolean", "Append", "None")


def _ring_step(capacity: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids = list(state.get[0]) if state.exists else []
        gone: list[int] = []
        for pdf in batches:
            for i in sorted(int(x) for x in pdf["id"]):
                ids.append(i)
                if len(ids) > capacity:
                    gone.append(ids.pop(0))
        state.update((ids,))
        yield pd.DataFrame({"key": [key[0]], "held": [len(ids)], "first": [ids[0] if ids else None], "last": [ids[-1] if ids else None], "evicted": [len(gone)]})

    return step


def ring(events: DataFrame, capacity: int = 32) -> DataFrame:
    """The span of ids that each key's ring holds after each batch, and how many it let go (key, id)."""
    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").applyInPandasWithState(_ring_step(capacity), f"key {kind}, held int, first long, last long, evicted int", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


def run_batch(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drains a stream into a memory table and returns it (tests and small results)."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return df.sparkSession.table(name)


__all__ = ["Watchdog", "first_seen", "ring", "run_batch", "sessions", "tumbling", "watchdog"]
