"""Approvals that hold over actions: grants of counted uses, spent in event order, all or nothing for each action.

Events of a session, in the order of ``seq``:

* ``mint``: a grant for (token, tool_name, argument_path, target or none), of ``uses`` uses for ``ttl`` seconds from ``at``;
  one of the same four replaces it. Only an issued token of level approval may get one.
* ``revoke``: takes that very grant away.
* ``action``: ``tool_name``, ``target`` and ``refs`` (token, path). Each pair counts once. A token that the session did not
  issue, or of a blocked class, fails the action; one of level hide_use needs no grant; one of level approval
  spends a use of the grant of its tool, path and target, or, where there is none of that target, of the grant
  without a target. Either all pairs have one and each spends a use, or nothing is spent.

Grants that have expired or are used up are pruned before each event. Rows are dealt by
session and streamed in order: a task holds the live grants of one session, never
its events, so a session of a third of all rows is long but small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from spanveil.functions import rules

TTL, MOST_TTL = 60.0, 3600.0
USES, MOST_USES = 1, 100
EVENT = "session string, seq long, at double, kind string, token string, tool_name string, argument_path string, target string, ttl double, uses int, refs array<struct<token:string,path:string>>, levels map<string,string>"
DECISION = "session string, seq long, kind string, ok boolean, reason string, spent int, active int"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


class Invalid(ValueError):
    """A tool name, path or target that no grant can name."""


def _part(x: str | None, fold: bool = False) -> str:
    t = (x or "").strip()
    if not t or len(t) > 512 or any(ord(c) < 32 for c in t):
        raise Invalid
    return t.casefold() if fold else t


def _grant(token: str, tool: str, path: str, target: str | None) -> tuple[str, str, str, str]:
    return token, tool, path, "" if target is None else f"={target}"


def step(held: dict, e: dict) -> tuple[bool, str | None, int]:
    """Applies an event to the live grants (grant: [expiry, uses]); whether it is granted, why not, and the uses spent."""
    for k in [k for k, (expires, uses) in held.items() if expires <= e["at"] or uses < 1]:
        del held[k]
    levels = dict(e["levels"] or {})
    try:
        tool = _part(e["tool_name"], True)
        target = None if e["target"] is None else _part(e["target"])
        if e["kind"] == "action":
            need = []
            for token, path in dict.fromkeys((r["token"], r["path"]) for r in e["refs"] or ()):
                path, level = _part(path), levels.get(token)
                if level is None or level == "blocked":
                    return False, level or "unknown", 0
                if level == "approval":
                    own = _grant(token, tool, path, target)
                    own = own if own in held else _grant(token, tool, path, None)
                    if own not in held:
                        return False, "no_grant", 0
                    need.append(own)
            if any(held[k][1] < need.count(k) for k in need):
                return False, "exhausted", 0
            for k in need:
                held[k][1] -= 1
                if not held[k][1]:
                    del held[k]
            return True, None, len(need)
        grant = _grant(e["token"], tool, _part(e["argument_path"]), target)
    except Invalid:
        return False, "invalid", 0
    if e["kind"] == "revoke":
        return (True, None, 0) if held.pop(grant, None) else (False, "no_grant", 0)
    ttl, uses = TTL if pd.isna(e["ttl"]) else float(e["ttl"]), USES if pd.isna(e["uses"]) else int(e["uses"])
    if not 0 < ttl <= MOST_TTL or not 1 <= uses <= MOST_USES:
        return False, "invalid", 0
    level = levels.get(e["token"])
    if level != "approval":
        return False, "unknown" if level is None else "not_gated", 0
    held[grant] = [e["at"] + ttl, uses]
    return True, None, 0


def with_levels(events: DataFrame, vault: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """events with ``levels``: of each token that they name and the session issued, its level. vault: session, placeholder, pii_class."""
    named = F.array_distinct(F.array_compact(F.array_append(F.transform(F.coalesce("refs", F.array().cast("array<struct<token:string,path:string>>")), lambda r: r["token"]), F.col("token"))))
    asked = events.select("session", "seq", F.explode(named).alias("token"))
    known = vault.select("session", F.col("placeholder").alias("token"), rules.level_of(F.col("pii_class"), policy).alias("level")).dropDuplicates(["session", "token"])
    levels = asked.join(known, ["session", "token"]).groupBy("session", "seq").agg(F.map_from_entries(F.collect_set(F.struct("token", "level"))).alias("levels"))
    return events.drop("levels").join(levels, ["session", "seq"], "left")


def decide(events: DataFrame) -> DataFrame:
    """What becomes of each event: session, seq, kind, ok, reason, spent (uses) and active (grants live after it)."""
    target = to_arrow_schema(_parse_datatype_string(DECISION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, held = None, {}
        for b in batches:
            out = []
            for e in b.to_pylist():
                if e["session"] != session:
                    session, held = e["session"], {}
                ok, reason, spent = step(held, e)
                out.append((session, e["seq"], e["kind"], ok, reason, spent, len(held)))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target, strict=True)], schema=target)

    return events.select(*_COLUMNS).repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, DECISION)


def live(events: DataFrame, at: float) -> DataFrame:
    """The grants that are live at a time, after all events up to it: session, token, tool_name, argument_path, target, expires_in and uses."""
    schema = "session string, token string, tool_name string, argument_path string, target string, expires_in double, uses int"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, held = None, {}

        def rows() -> pa.RecordBatch:
            out = [(session, *k[:3], k[3][1:] if k[3] else None, x - at, n) for k, (x, n) in held.items() if x > at]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in target]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target, strict=True)], schema=target)

        for b in batches:
            for e in b.to_pylist():
                if e["session"] != session:
                    yield rows()
                    session, held = e["session"], {}
                step(held, e)
        yield rows()

    return events.where(F.col("at") <= at).select(*_COLUMNS).repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, schema)


def prompt(grants: DataFrame) -> DataFrame:
    """What a planner may know of each session's live grants: tokens and uses, no values, no contexts."""
    each = F.array_sort(F.collect_list(F.concat("token", F.lit(" ("), F.col("uses").cast("string"), F.lit(" exact local use(s))"))))
    return grants.groupBy("session").agg(F.array_join(each, ", ").alias("approvals"))


class Ledger(StatefulProcessor):
    """The same over a stream: a session's live grants are its state, and a timer at each expiry drops what is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "token string, tool string, path string, target string", "expires double, uses int")

    def _load(self) -> dict:
        return {tuple(k): [v[0], v[1]] for k, v in self.held.iterator()} if self.held.exists() else {}

    def _save(self, before: dict, now: dict) -> None:
        for k in before:
            if k not in now:
                self.held.removeKey(k)
        for k, v in now.items():
            if before.get(k) != v:
                self.held.updateValue(k, tuple(v))
                if k not in before or before[k][0] != v[0]:
                    self.handle.registerTimer(int(v[0] * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._load()
        before, out = {k: list(v) for k, v in held.items()}, []
        for e in pd.concat(list(rows)).sort_values("seq").to_dict("records"):  # the whole batch, not each Arrow chunk, in order
            for c in ("token", "tool_name", "argument_path", "target", "refs", "levels"):
                e[c] = None if e[c] is None or isinstance(e[c], float) else e[c]
            e["refs"] = list(e["refs"]) if e["refs"] is not None else None
            ok, reason, spent = step(held, e)
            out.append((key[0], e["seq"], e["kind"], ok, reason, spent, len(held)))
        self._save(before, held)
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "ok", "reason", "spent", "active"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = self._load()
        left = {k: v for k, v in held.items() if int(v[0] * 1000) > at}
        self._save(held, left)
        if len(left) < len(held):
            yield pd.DataFrame([(key[0], -1, "expired", True, None, 0, len(left))], columns=["session", "seq", "kind", "ok", "reason", "spent", "active"])

    def close(self) -> None:
        pass


def stream(events: DataFrame, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Decisions over a stream of events with an event time; also a row of kind ``expired`` when the watermark drops grants. Needs the RocksDB state store."""
    rows = events.withWatermark(ts, lateness).withColumn("at", F.col(ts).cast("double"))
    return rows.select(ts, *_COLUMNS).groupBy("session").transformWithStateInPandas(Ledger(), DECISION, "Append", "EventTime")
