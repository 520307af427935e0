"""Stateful streams of an agent's run: its bounded trace, a mirror of its calls, and a monitor of its connections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS, PENDING, MIRRORED = 200, 8, 48


def _batch(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """All rows of a key in a batch in order; an Arrow chunk is only a part of them."""
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


class Trace(StatefulProcessor):
    """The last events and the last undelivered notes of a run; an event id counts once while the watermark has not passed it.

    Events (run, id, ts, step, kind, detail): ``note`` queues its detail, ``drain`` gives all
    queued notes out and empties the queue, others only stand in the trace. Ids are kept with a timer each,
    so they go when no repeat of them can come any more.
    """

    SCHEMA = "run string, id string, kind string, held int, first_step long, pending int, drained array<string>"

    def __init__(self, events: int = EVENTS, pending: int = PENDING, lateness_ms: int = 600_000) -> None:
        self.most, self.queue, self.lateness = events, pending, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "step long, kind string, detail string")
        self.pending = handle.getListState("pending", "detail string")
        self.seen = handle.getMapState("seen", "id string", "until long")

    def _ids(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.seen.iterator()} if self.seen.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [tuple(x) for x in self.events.get()] if self.events.exists() else []
        notes = [x[0] for x in self.pending.get()] if self.pending.exists() else []
        ids, out = self._ids(), []
        for r in _batch(rows, "step", "id").itertuples(index=False):
            if r.id in ids:
                continue
            ids[r.id] = until = int(pd.Timestamp(r.ts).timestamp() * 1000) + self.lateness
            self.seen.updateValue((r.id,), (until,))
            self.handle.registerTimer(until)
            drained = None
            if r.kind == "note":
                notes = [*notes, r.detail][-self.queue :]
            elif r.kind == "drain":
                drained, notes = notes, []
            events = [*events, (int(r.step), r.kind, r.detail)][-self.most :]
            out.append((key[0], r.id, r.kind, len(events), events[0][0], len(notes), drained))
        self.events.put(events) if events else self.events.clear()
        self.pending.put([(n,) for n in notes]) if notes else self.pending.clear()
        yield pd.DataFrame(out, columns=["run", "id", "kind", "held", "first_step", "pending", "drained"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for i, until in self._ids().items():
            if until <= now:
                self.seen.removeKey((i,))
        yield pd.DataFrame([], columns=["run", "id", "kind", "held", "first_step", "pending", "drained"])

    def close(self) -> None:
        pass


def traces(events: DataFrame, ts: str = "ts", lateness: str = "10 minutes", most: int = EVENTS, pending: int = PENDING) -> DataFrame:
    """What stands in each run's trace after each new event (run, id, step, kind, detail and an event time)."""
    amount, unit = lateness.split()
    ms = int(amount) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1000
    rows = events.withWatermark(ts, lateness).select("run", F.col(ts).alias("ts"), "id", "step", "kind", "detail")
    return rows.groupBy("run").transformWithStateInPandas(Trace(most, pending, ms), Trace.SCHEMA, "Append", "EventTime")


class Mirror(StatefulProcessor):
    """Copies of a run's newest calls: a call is taken once its images are all there, and beyond ``most`` the smallest ids go."""

    SCHEMA = "run string, call_id long, state string, held int"

    def __init__(self, most: int = MIRRORED) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "call_id long", "images int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.calls.iterator()} if self.calls.exists() else {}
        out = []
        for r in _batch(rows, "tick", "call_id").itertuples(index=False):
            call = int(r.call_id)
            if call in held or r.fetched < r.images:  # known, or tried again at a later tick
                continue
            held[call] = int(r.images)
            self.calls.updateValue((call,), (int(r.images),))
            out.append((key[0], call, "mirrored", min(len(held), self.most)))
            while len(held) > self.most:
                oldest = min(held)
                del held[oldest]
                self.calls.removeKey((oldest,))
                out.append((key[0], oldest, "evicted", len(held)))
        yield pd.DataFrame(out, columns=["run", "call_id", "state", "held"])

    def close(self) -> None:
        pass


def mirror(ticks: DataFrame, most: int = MIRRORED) -> DataFrame:
    """Calls as they enter and leave each run's mirror; ticks: run, tick, call_id, images (how many it has) and fetched."""
    return ticks.select("run", "tick", "call_id", "images", "fetched").groupBy("run").transformWithStateInPandas(Mirror(most), Mirror.SCHEMA, "Append", "None")


class Monitor:
    """Watches samples of connections until the first that breaks the rule.

    Every batch adds its samples' distinct connections to a table of its own number, written anew if the
    batch runs again, so a restart changes nothing. A batch with a violation is the last that is
    kept: later batches find the latch (a table) and add nothing. ``report`` has the verdict at any time.
    """

    def __init__(self, folder: str, allowed: Column, columns: tuple[str, ...] = ("pid", "process", "local", "remote"), sample: str = "sample") -> None:
        self.folder, self.allowed, self.columns, self.sample = folder, allowed, columns, sample

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def add(self, rows: DataFrame, number: int) -> None:
        """One batch: samples numbered by ``sample``; those after the first with a violation do not count."""
        latched = self.latched(rows.sparkSession)
        if latched is not None and latched < number:
            return
        bad = ~F.coalesce(self.allowed, F.lit(False))
        first = rows.where(bad).agg(F.min(self.sample)).first()[0]
        kept = rows if first is None else rows.where(F.col(self.sample) <= F.lit(first))
        seen = kept.select(*self.columns, bad.alias("violation")).distinct()
        self._write(seen, "connections", number)
        self._write(kept.agg(F.count_distinct(self.sample).alias("samples")), "samples", number)
        if first is not None:
            self._write(rows.sparkSession.range(1).select(F.lit(number).cast("long").alias("at")), "latch", number)

    def latched(self, spark) -> int | None:
        """The batch that broke the rule, if one did."""
        try:
            return spark.read.parquet(f"{self.folder}/latch").agg(F.min("at")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def start(self, samples: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return samples.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def report(self, spark) -> DataFrame:
        """One row: verdict, samples, connections (distinct, sorted) and violations."""
        c = spark.read.parquet(f"{self.folder}/connections").select(F.struct(*self.columns).alias("c"), "violation").distinct()
        n = spark.read.parquet(f"{self.folder}/samples").agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"))
        # one row each
        all_ = c.agg(F.array_sort(F.collect_set("c")).alias("connections"), F.array_sort(F.collect_set(F.when(F.col("violation"), F.col("c")))).alias("violations"))
        return n.crossJoin(all_).select(F.when(F.size("violations") > 0, "failed").otherwise("passed").alias("verdict"), "samples", "connections", "violations")
