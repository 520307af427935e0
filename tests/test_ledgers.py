"""Traces, mirrors, monitors and imports over batches and restarts."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanveil.functions import rules
from spanveil.streaming import imports, ledgers


@pytest.fixture
def files(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = tmp_path / "in"
    d.mkdir()

    def put(rows):
        n = len(list(d.iterdir()))
        f = d / f"{n:03d}.json"
        f.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in order of their times

    put.folder, put.tmp = str(d), tmp_path
    return put


def run(spark, df, name, tmp):
    """Drains what is there; a query of the same checkpoint goes on where it stopped."""
    out = []
    q = df.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def read(spark, put, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(put.folder)


TRACE = "run string, id string, ts timestamp, step long, kind string, detail string"


def event(i, step=None, kind="act", minute=None, run="r"):
    at = datetime(2024, 1, 1) + timedelta(minutes=step if minute is None else minute)
    return {"run": run, "id": i, "ts": at.isoformat() + "Z", "step": step, "kind": kind, "detail": f"d{i}"}


def test_trace_is_bounded_and_counts_ids_once(spark, files):
    files([event(f"a{k}", k, "note" if k % 2 else "act") for k in range(9, -1, -1)])  # one batch, out of order
    files([event("a3", 3), event("a9", 9), event("b", 10, "note"), event("o", 10, run="other")])  # repeats
    go = lambda: run(spark, ledgers.traces(read(spark, files, TRACE), lateness="10 minutes", most=6, pending=3), "c", files.tmp)
    out = [r for r in go() if r["run"] == "r"]
    assert [r["id"] for r in out] == [f"a{k}" for k in range(10)] + ["b"]
    assert [(r["held"], r["first_step"], r["pending"]) for r in out][-2:] == [(6, 4, 3), (6, 5, 3)]
    files([event("c", 11, "drain"), event("a9", 9)])  # after a restart the state is still there
    out = [r for r in go() if r["run"] == "r"]
    assert [(r["id"], r["drained"], r["pending"]) for r in out] == [("c", ["da7", "da9", "db"], 0)]
    files([event("x", 900)])  # the watermark passes all; late events are dropped, and ids are forgotten
    files([event("a9", 901, minute=2), event("y", 901)])
    files([event("a9", 902)])
    out = [r["id"] for r in go() if r["run"] == "r"]
    assert out == ["x", "y", "a9"]


CALL = "run string, tick long, call_id long, images int, fetched int"


def test_mirror_evicts_the_oldest(spark, files):
    call = lambda t, i, images=0, fetched=0, run="r": {"run": run, "tick": t, "call_id": i, "images": images, "fetched": fetched}
    files([call(1, i) for i in (5, 3, 4)] + [call(1, 6, 2, 1), call(1, 1, run="s")])
    files([call(2, 6, 2, 2), call(2, 5), call(2, 9)])
    go = lambda: run(spark, ledgers.mirror(read(spark, files, CALL), 3), "c", files.tmp)
    out = [(r["call_id"], r["state"], r["held"]) for r in go() if r["run"] == "r"]
    assert out == [(3, "mirrored", 1), (4, "mirrored", 2), (5, "mirrored", 3), (6, "mirrored", 3), (3, "evicted", 3), (9, "mirrored", 3), (4, "evicted", 3)]
    files([call(3, 3), call(3, 10)])  # after a restart; an evicted call that shows again goes at once
    out = [(r["call_id"], r["state"]) for r in go() if r["run"] == "r"]
    assert out == [(3, "mirrored"), (3, "evicted"), (10, "mirrored"), (5, "evicted")]


def test_monitor_latches(spark, files, tmp_path):
    schema = "sample long, pid int, process string, local string, remote string"
    row = lambda s, remote, pid=1: {"sample": s, "pid": pid, "process": "p", "local": "127.0.0.1:9", "remote": remote}
    m = ledgers.Monitor(str(tmp_path / "out"), rules.is_loopback(F.col("remote")))
    go = lambda: m.start(read(spark, files, schema), str(tmp_path / "c")).awaitTermination()
    files([row(1, "127.0.0.1:80"), row(2, "127.0.0.1:80"), row(2, "[::1]:80", 2)])
    go()
    r = m.report(spark).first()
    assert (r["verdict"], r["samples"], len(r["connections"]), r["violations"]) == ("passed", 2, 2, []) and m.latched(spark) is None
    files([row(3, "127.0.0.1:81"), row(4, "8.8.8.8:53"), row(4, None), row(5, "9.9.9.9:53")])
    files([row(6, "7.7.7.7:1")])
    go()
    r = m.report(spark).first()
    assert (r["verdict"], r["samples"]) == ("failed", 4) and m.latched(spark) == 1
    assert [x["remote"] for x in r["violations"]] == [None, "8.8.8.8:53"] and "7.7.7.7:1" not in str(r["connections"]) and "9.9.9.9" not in str(r["connections"])
    m.add(spark.createDataFrame([(3, 1, "p", "127.0.0.1:9", "127.0.0.1:81"), (4, 1, "p", "127.0.0.1:9", "8.8.8.8:53"), (4, 1, "p", "127.0.0.1:9", None), (5, 1, "p", "l", "9.9.9.9:53")], schema), 1)  # the batch runs again
    assert m.report(spark).first() == r


def screen(i, labels=1, **more):
    return {"id": i, "platform": "web" if i % 2 else "phone", "task_folder": f"t{i % 3}", "task_goal": f"buy {i}", "step_index": i, "image": f"{i}.png", "privacy_labels": [{"label": "high", "category": None, "ocr_text": f"secret {k}"} for k in range(labels)]} | more


def test_import_runs_each_batch_once(spark, files, tmp_path, monkeypatch):
    out, check = str(tmp_path / "out"), str(tmp_path / "c")
    files([screen(i, i % 3) for i in range(5)])
    files([screen(i) for i in range(5, 8)])
    stream = lambda: read(spark, files, imports.SCREEN)
    imports.start(stream(), out, check).awaitTermination()
    files([screen(8), screen(9)])
    whole = imports.projected
    calls = []

    def fails(rows, texts=False):  # the batch is written, and the job is lost before it is noted
        whole(rows, texts).write.mode("overwrite").parquet(f"{out}/batch=2")
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(imports, "projected", fails)
    with pytest.raises(Exception, match="lost"):
        imports.start(stream(), out, check).awaitTermination()
    monkeypatch.setattr(imports, "projected", whole)
    imports.start(stream(), out, check).awaitTermination()
    got = imports.imported(spark, out)
    assert calls and sorted(r["id"] for r in got.collect()) == list(range(10))
    assert "secret" not in str(got.collect()) and "buy" not in str(got.collect())
    m = imports.manifest(got).first()
    assert (m["records"], m["annotations"], m["unannotated"], m["trajectories"]) == (10, 9, 2, 3)
    assert [tuple(x) for x in m["platforms"]] == [("phone", 5), ("web", 5)] and [tuple(x) for x in m["categories"]] == [("unknown", 9)]
    batch = imports.projected(spark.read.schema(imports.SCREEN).json(files.folder))
    assert imports.manifest(batch.select(got.columns)).first() == m
    files([{"id": 3, "platform": "web"}])
    with pytest.raises(Exception, match="row without task_folder, task_goal"):
        imports.start(stream(), out, check).awaitTermination()
