"""Approvals over actions, token references, markers and log lines."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanveil.operators import approvals, ledger, vault

TOKENS = {"API_KEY_1_0000": "approval", "AUTH_TOKEN_1_0000": "approval", "EMAIL_1_0000": "hide_use", "SSN_1_0000": "blocked"}


def events(seed, n=400):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        kind = rnd.choice(["mint", "mint", "action", "action", "action", "revoke"])
        pick = lambda: rnd.choice([*TOKENS, "API_KEY_1_0000", "API_KEY_1_0000", "NAME_9_0000"] if rnd.random() < 0.3 else ["API_KEY_1_0000", "AUTH_TOKEN_1_0000"])
        rows.append(
            {
                "session": f"s{rnd.randrange(3)}",
                "seq": i,
                "at": 60.0 + i,
                "kind": kind,
                "token": pick(),
                "tool_name": rnd.choice(["Send", " send ", "SEND", "open", "", "x\ty"] if rnd.random() < 0.1 else ["Send", "send"]),
                "argument_path": rnd.choice(["$.a", "$.b "]),
                "target": rnd.choice([None, "A", "B"]),
                "ttl": rnd.choice([None, 10.0, 100.0, 5000.0, 0.0]),
                "uses": rnd.choice([None, 1, 2, 3, 0, 101]),
                "refs": [{"token": pick(), "path": rnd.choice(["$.a", "$.b"])} for _ in range(rnd.randrange(1, 4))] if kind == "action" else None,
                "levels": dict(TOKENS),
            }
        )
    return rows


def plain(rows):
    """One list of grants a session, searched through for every event."""
    held, out = {}, {}
    for e in sorted(rows, key=lambda r: r["seq"]):
        live = held[e["session"]] = [g for g in held.get(e["session"], []) if g["end"] > e["at"] and g["left"] > 0]
        tool, out[e["seq"]] = e["tool_name"].strip().lower(), False
        if not tool or "\t" in tool:
            continue
        if e["kind"] == "action":
            pairs, using = {(r["token"], r["path"].strip()) for r in e["refs"]}, []
            ok = all(TOKENS.get(t) in ("hide_use", "approval") for t, _ in pairs)
            for t, p in pairs:
                if ok and TOKENS[t] == "approval":
                    fit = [g for g in live if (g["token"], g["tool"], g["path"]) == (t, tool, p) and g["target"] in (e["target"], None)]
                    fit.sort(key=lambda g: g["target"] is None)
                    using += fit[:1]
                    ok = ok and bool(fit)
            if ok:
                for g in using:
                    g["left"] -= 1
                    g["spent"] += 1
                    assert g["spent"] <= g["uses"]
            out[e["seq"]] = ok
            continue
        name = (e["token"], tool, e["argument_path"].strip(), e["target"])
        same = [g for g in live if (g["token"], g["tool"], g["path"], g["target"]) == name]
        if e["kind"] == "revoke":
            out[e["seq"]] = bool(same)
            held[e["session"]] = [g for g in live if g not in same]
        elif TOKENS.get(e["token"]) == "approval" and 0 < (60 if e["ttl"] is None else e["ttl"]) <= 3600 and 1 <= (1 if e["uses"] is None else e["uses"]) <= 100:
            uses = e["uses"] or 1
            held[e["session"]] = [g for g in live if g not in same] + [dict(zip(("token", "tool", "path", "target"), name, strict=True), end=e["at"] + (e["ttl"] or 60), left=uses, uses=uses, spent=0)]
            out[e["seq"]] = True
    return out, held


@pytest.mark.parametrize("seed", [1, 2])
def test_grants_are_spent_in_order(spark, seed):
    rows = events(seed)
    got = {r["seq"]: r for r in approvals.decide(spark.createDataFrame(rows, approvals.EVENT).repartition(5)).collect()}
    want, held = plain(rows)
    assert {k: r["ok"] for k, r in got.items()} == want
    assert {r["reason"] for r in got.values()} >= {None, "no_grant", "invalid", "blocked", "unknown", "not_gated"}
    now = approvals.live(spark.createDataFrame(rows, approvals.EVENT), 459.0)
    left = sorted((s, g["token"], g["target"] or "", g["left"]) for s, gs in held.items() for g in gs if g["end"] > 459 and g["left"])
    assert sorted((r["session"], r["token"], r["target"] or "", r["uses"]) for r in now.collect()) == left
    assert all(" exact local use(s)" in r["approvals"] for r in approvals.prompt(now).collect())


def test_one_use_serves_one_action(spark):
    base = {"argument_path": "$.to", "tool_name": "send", "ttl": None, "levels": TOKENS, "session": "s"}
    ref = {"token": "API_KEY_1_0000", "path": "$.to"}
    rows = [
        base | {"seq": 1, "at": 1.0, "kind": "mint", "token": "API_KEY_1_0000", "uses": 1},
        base | {"seq": 2, "at": 2.0, "kind": "action", "target": "x", "refs": [ref, ref]},
        base | {"seq": 3, "at": 3.0, "kind": "action", "target": "y", "refs": [ref]},
    ]
    got = approvals.decide(spark.createDataFrame(rows, approvals.EVENT)).orderBy("seq").collect()
    assert [(r["ok"], r["spent"], r["active"]) for r in got] == [(True, 0, 1), (True, 1, 0), (False, 0, 0)]


def test_levels_come_from_the_vault(spark):
    rows = [{"session": "s", "seq": 1, "at": 1.0, "kind": "action", "tool_name": "t", "refs": [{"token": "EMAIL_1_0000", "path": "$"}]}, {"session": "z", "seq": 2, "at": 1.0, "kind": "action", "tool_name": "t", "refs": [{"token": "EMAIL_1_0000", "path": "$"}]}]
    known = spark.createDataFrame([("s", "EMAIL_1_0000", "EMAIL")], "session string, placeholder string, pii_class string")
    got = approvals.decide(approvals.with_levels(spark.createDataFrame(rows, approvals.EVENT), known)).collect()
    assert {(r["session"], r["ok"], r["reason"]) for r in got} == {("s", True, None), ("z", False, "unknown")}
    assert approvals.decide(spark.createDataFrame([], approvals.EVENT)).count() == 0


def test_stream_agrees_and_timers_drop_grants(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, d = events(3, 300), tmp_path / "in"
    d.mkdir()
    for k in range(3):  # three batches, each out of order
        part = rows[100 * k : 100 * k + 100]
        random.Random(k).shuffle(part)
        (d / f"{k}.json").write_text("\n".join(json.dumps(r | {"ts": f"1970-01-01T00:{int(r['at']) // 60:02d}:{int(r['at']) % 60:02d}Z"}) for r in part))
    late = {"session": "s9", "seq": 999, "kind": "revoke", "token": "x", "tool_name": "t", "argument_path": "$", "ts": "1970-01-02T00:00:00Z"}
    (d / "3.json").write_text(json.dumps(late))
    (d / "4.json").write_text(json.dumps(late | {"seq": 1000}))
    for n, f in enumerate(sorted(d.iterdir(), key=lambda f: (len(f.stem), f.stem))):
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in order of their times
    s = spark.readStream.schema("ts timestamp, " + approvals.EVENT).option("maxFilesPerTrigger", 1).json(str(d))
    q = approvals.stream(s).writeStream.format("memory").queryName("approvals").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("approvals").collect()
    batch = {r["seq"]: (r["ok"], r["reason"], r["spent"]) for r in approvals.decide(spark.createDataFrame(rows, approvals.EVENT)).collect()}
    assert {r["seq"]: (r["ok"], r["reason"], r["spent"]) for r in got if 0 <= r["seq"] < 900} == batch
    ended = [r for r in got if r["kind"] == "expired"]
    assert ended and any(r["active"] == 0 for r in ended)


def test_references_resolve_in_one_pass(spark):
    v = spark.createDataFrame([("NAME_1_0000", "see NAME_2_0000"), ("NAME_2_0000", "Bob $1 \\")], "placeholder string, value string")
    rows = [(None, "a « NAME_1_0000 » b", "z"), (1, "«NAME_2_0000»NAME_9_0000", "z"), (1, "NAME_2_0000", "z"), (2, None, "z"), (3, "plain «x»", "z")]
    got = sorted(((r["k"], r["resolved"], tuple(r["unknown"]), r["row"]) for r in vault.resolve(spark.createDataFrame(rows, "k int, text string, row string"), v, "k").collect()), key=repr)
    assert got == sorted([(None, "a see NAME_2_0000 b", (), "z"), (1, "Bob $1 \\NAME_9_0000", ("NAME_9_0000",), "z"), (1, "Bob $1 \\", (), "z"), (2, None, (), "z"), (3, "plain «x»", (), "z")], key=repr)


def test_log_lines_never_keep_the_task(spark):
    ends = ["", " ", "\t", " ", " ", "\x1f", "\x85", "\x1b[31m"]
    rows = [(a + "user: write a letter to Bob" + b,) for a in ends for b in ends] + [(a + "--- task: click action" + b,) for a in ends for b in ends]
    assert spark.createDataFrame(rows, "t string").select(ledger.log_line(F.col("t")).alias("l")).where("l is not null").count() == 0
    assert spark.createDataFrame([(a + "click here",) for a in ends], "t string").select(ledger.log_line(F.col("t")).alias("l")).where("l.text = 'click here'").count() == len(ends)


def test_markers_once(spark):
    t = [(1, 1, "⟦TOOL:sort:« A_1_0000 », B_1_0000 :x⟧⟦TOOL:echo:C_1_0000:x⟧⟦TOOL:echo:D_1_0000:y⟧"), (1, 2, "⟦TOOL:echo:D_1_0000:x⟧⟦TOOL:echo:«E_1_0000»:z⟧"), (2, 1, "⟦TOOL:echo:D_1_0000:x⟧"), (2, 2, None)]
    got = ledger.new_markers(spark.createDataFrame(t, "c int, turn int, text string"), "c", "turn").collect()
    assert sorted((r["c"], r["turn"], r["m"]["id"], tuple(r["m"]["tokens"])) for r in got) == [(1, 1, "x", ("A_1_0000", "B_1_0000")), (1, 2, "z", ("E_1_0000",)), (2, 1, "x", ("D_1_0000",))]


def test_only_the_named_program_ends(spark):
    d = spark.createDataFrame([("--- holo exit: 0",), ("--- other exit: 0",), ("\t--- redaction ON",)], "t string")
    assert [r[0] for r in d.select(ledger.runner_event(F.col("t"))).collect()] == ["agent_finished", None, "engine_ready"]
    assert d.select(ledger.runner_event(F.col("t"), "other").alias("e")).where("e = 'agent_finished'").count() == 1
