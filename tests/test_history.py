"""The store of past runs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from spanveil.sources import history

A, B, C = "run-20240101-000001-00aa", "run-20240102-000002-00bb", "run-20240103-000003-00cc"


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path / "runs")
    runs = [(A, json.dumps({"id": A, "prompt": "p", "started_at": 1.5, "finished_at": 0, "status": "running", "settings": {"x": 1}})), (B, json.dumps({"id": B, "prompt": None, "status": "done"}))]
    history.save(spark.createDataFrame(runs, "run_id string, record string"), root, "run")
    calls = [(r, i, json.dumps({"id": i, "model": "m", "request": "long", "response": "long"})) for r, n in ((A, 3), (B, 1)) for i in range(1, n + 1)]
    history.save(spark.createDataFrame(calls, "run_id string, call_id long, record string").repartition(3), root, "call")
    images = [(A, 1, 0, "image/png", b"a"), (A, 1, 1, "image/webp", b"b"), (B, 1, 0, "text/x", b"c")]
    history.save(spark.createDataFrame(images, "run_id string, call_id long, image int, media_type string, content binary"), root, "images")
    for name, text in ((f"{C}/run.json", "{broken"), (f"{A}/calls/0009.json", "[]"), ("other/run.json", "{}")):
        p = tmp_path / "runs" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_views(spark, store):
    assert [tuple(r) for r in history.view(spark, store).orderBy(F.desc("run_id")).collect()] == [(B, None, None, None, "done", 1), (A, "p", 1.5, 0.0, "running", 4)]
    assert json.loads(history.view(spark, store, "run").where(F.col("run_id") == A).first()["record"])["settings"] == {"x": 1}
    calls = history.view(spark, store, "calls").orderBy("run_id", "call_id").collect()
    assert [(r["run_id"], r["call_id"], json.loads(r["record"])) for r in calls] == [(r, i, {"id": i, "model": "m"}) for r, n in ((A, 3), (B, 1)) for i in range(1, n + 1)]
    one = history.view(spark, store, "call").where((F.col("run_id") == A) & F.col("call_id").isin(2, 7)).collect()
    assert [(r["call_id"], json.loads(r["record"])["request"]) for r in one] == [(2, "long")]
    images = history.view(spark, store, "images").orderBy("run_id", "image").collect()
    assert [(r["run_id"], r["image"], r["media_type"], bytes(r["content"])) for r in images] == [(A, 0, "image/png", b"a"), (A, 1, "image/webp", b"b"), (B, 0, "application/octet-stream", b"c")]
    assert history.view(spark, store + "/nowhere").count() == 0
    assert history.view(spark, "file://" + store, "calls").where(F.col("run_id") == "../other").count() == 0


def test_other_runs_are_not_opened(spark, store, monkeypatch):
    opened, listed = [], []
    read, names = history._bytes, history._listed
    monkeypatch.setattr(history, "_bytes", lambda s, p: opened.append(p) or read(s, p))
    monkeypatch.setattr(history, "_listed", lambda s, p: listed.append(p) or names(s, p))
    r = history._Reader(store, "call")
    more = GreaterThan(("call_id",), 0)
    assert list(r.pushFilters([EqualTo(("run_id",), A), In(("call_id",), (2, 3)), more])) == [more]
    rows = [x for p in r.partitions() for x in r.read(p)]
    assert [x[:2] for x in rows] == [(A, 2), (A, 3)] and not listed
    assert opened == [f"{store}/{A}/calls/0002.json", f"{store}/{A}/calls/0003.json"]
    opened.clear()
    runs = history._Reader(store, "runs")
    assert len([x for p in runs.partitions() for x in runs.read(p)]) == 2
    assert all(p.endswith("/run.json") for p in opened)  # calls are counted, not opened
    plan = history.view(spark, store, "call").where(F.col("run_id") == A)._jdf.queryExecution().executedPlan().toString()
    assert f"= {A}" not in plan  # pushed down


def test_records_are_replaced_and_checked(spark, store):
    kind = "run_id string, record string"
    history.save(spark.createDataFrame([(A, '{"status": "done"}')], kind), store, "run")
    assert history.view(spark, store).where(F.col("run_id") == A).first()["status"] == "done"
    for bad in (spark.createDataFrame([("../x", "{}")], kind), spark.createDataFrame([(A, "no json")], kind)):
        with pytest.raises(Exception, match="run-YYYYMMDD|Expecting value"):
            history.save(bad, store, "run")
    with pytest.raises(Exception, match="no view"):
        history.view(spark, store, "nothing").collect()
