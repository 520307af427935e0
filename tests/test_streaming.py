"""Streaming operators, drained from small files."""

import json

from spanveil.streaming import operators as st


def stream(spark, tmp_path, rows, schema):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.readStream.schema(schema).json(str(d))


def test_first_seen(spark, tmp_path):
    s = stream(spark, tmp_path, [{"id": 1, "ts": "2024-01-01T00:00:00"}, {"id": 1, "ts": "2024-01-01T00:01:00"}, {"id": 2, "ts": "2024-01-01T00:02:00"}], "id int, ts timestamp")
    assert sorted(r["id"] for r in st.run_batch(st.first_seen(s, ["id"]), "first", checkpoint=str(tmp_path / "c")).collect()) == [1, 2]


def test_tumbling(spark, tmp_path):
    s = stream(spark, tmp_path, [{"k": "a", "value": 1.0, "ts": "2024-01-01T00:10:00"}, {"k": "a", "value": 2.0, "ts": "2024-01-01T00:50:00"}, {"k": "a", "value": 4.0, "ts": "2024-01-01T01:10:00"}], "k string, value double, ts timestamp")
    got = st.run_batch(st.tumbling(s, ["k"]), "tumbling", "complete", str(tmp_path / "c"))
    assert sorted((r["n"], r["value"]) for r in got.collect()) == [(1, 4.0), (2, 3.0)]


def test_ring(spark, tmp_path):
    got = st.run_batch(st.ring(stream(spark, tmp_path, [{"key": "a", "id": i} for i in range(10)], "key string, id long"), 4), "ring", "update", str(tmp_path / "c"))
    assert [(r["held"], r["first"], r["last"], r["evicted"]) for r in got.collect()] == [(4, 6, 9, 6)]


def test_watchdog(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [{"key": "a", "step": i, "kind": "error" if i in (1, 2, 4) else "ok"} for i in range(7)]
    got = st.run_batch(st.watchdog(stream(spark, tmp_path, rows, "key string, step long, kind string")), "watchdog", checkpoint=str(tmp_path / "c"))
    assert [(r["step"], r["halted"]) for r in got.orderBy("step").collect()] == [(i, i >= 4) for i in range(7)]


def test_watchdog_orders_the_whole_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [{"key": "a", "step": i, "kind": "error" if i < 3 else "ok"} for i in range(20)][::-1]
        got = st.run_batch(st.watchdog(stream(spark, tmp_path, rows, "key string, step long, kind string")), "ordered", checkpoint=str(tmp_path / "c"))
        assert [(r["step"], r["halted"]) for r in got.orderBy("step").collect()] == [(i, i >= 2) for i in range(20)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
