"""Buffered feeds, JSON walks and token windows against plain versions."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil.operators import evaluate, feed, walks, windows


def drawn(seed, use, number, below):
    return int(hashlib.md5(f"{seed}:{use}:{number}".encode()).hexdigest()[:8], 16) % below


def simulated(n, seed, buffer):
    """The reader's own loop."""
    held, out = list(range(min(n, buffer))), []
    for step, row in enumerate(range(len(held), n)):
        k = drawn(seed, "slot", step, len(held))
        out.append(held[k])
        held[k] = row
    return out + [held[k] for k in sorted(range(len(held)), key=lambda k: (drawn(seed, "rest", k, 1 << 32), k))]


@pytest.mark.parametrize(("n", "buffer"), [(500, 40), (30, 40), (1, 1), (100, 1), (64, 64)])
def test_buffered_feed(spark, n, buffer):
    for parts in (1, 7):
        rows = spark.range(n).withColumn("back", -F.col("id")).repartition(parts)
        got = feed.buffered(rows, F.desc("back"), seed=5, buffer=buffer).orderBy("position").collect()
        assert [r["id"] for r in got] == simulated(n, 5, buffer) and [r["position"] for r in got] == list(range(1, n + 1))


def test_feed_edges(spark):
    assert feed.buffered(spark.range(0), "id", seed=1).count() == 0
    fed = feed.buffered(spark.range(100), "id", seed=2, buffer=10)
    some = feed.taken(fed, F.col("id") % 2 == 0, 20).orderBy("place").collect()
    assert [r["id"] for r in some] == [i for i in simulated(100, 2, 10) if i % 2 == 0][:20]
    with pytest.raises(ValueError, match="50 accepted"):
        feed.taken(fed, F.col("id") % 2 == 0, 51)
    with pytest.raises(ValueError):
        feed.buffered(spark.range(3), "id", seed=1, buffer=0)


def plain_nodes(x, path="$"):
    yield path, x
    for k, y in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from plain_nodes(y, f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]")


def document(rnd, depth):
    kind = rnd.choice(["d", "l", "s"]) if depth else "s"
    if kind == "d":
        return {rnd.choice(["a", "b c", "text", "ünï", "d.e", "value"]) + str(i): document(rnd, depth - 1) for i in range(rnd.randrange(4))}
    if kind == "l":
        return [document(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return rnd.choice(["", "see EMAIL_1_0000, « NAME_2_00ff » EMAIL_1_0000", 1, 2.5, True, None, "x"])


def test_walks(spark):
    rnd = random.Random(8)
    docs = [(i, document(rnd, 6)) for i in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [(90, "not json"), (91, None), (91, '{"a": "EMAIL_3_0000"}')], "id int, action string")
    got = walks.nodes(df, "id", "action").where("id < 90")
    assert sorted((r["id"], r["path"]) for r in got.collect()) == sorted((i, p) for i, d in docs for p, _ in plain_nodes(d))
    want = sorted((i, p, v) for i, d in docs for p, v in plain_nodes(d) if isinstance(v, str))
    texts = walks.texts(df, "id")
    assert sorted((r["id"], r["path"], r["value"]) for r in texts.where("id < 90").collect()) == want
    assert "Python" not in texts._jdf.queryExecution().executedPlan().toString()
    refs = sorted((i, p, t) for i, p, v in want for t in dict.fromkeys(re.findall(r"[A-Z]+_[1-9]_[0-9a-f]{4}", v)))
    assert sorted(tuple(r) for r in walks.references(df, "id").where("id < 90").collect()) == refs
    assert {tuple(r) for r in walks.references(df, "id").where("id >= 90").collect()} == {(91, "$.a", "EMAIL_3_0000")}
    assert [r["id"] for r in walks.broken(df, "id", "action").collect()] == [90]
    assert walks.nodes(df.limit(0), "id", "action").count() == 0
    assert walks.objects(df, "id", "action").where("id < 90").count() == sum(isinstance(v, dict) for _, d in docs for _, v in plain_nodes(d))


def test_forbidden_fields_at_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":{"OcrText":{"z":1}}}],"texts":1}'), (2, '[[{"fileName":null}]]'), (3, '{"valued":"value"}')], "id int, r string")
    assert {tuple(r) for r in walks.forbidden(df, "id", "r").collect()} == {(1, "$.a[0].b.OcrText"), (2, "$[0][0].fileName")}


def test_tools_and_system_text(spark):
    doc = {"tools": [{"function": {"name": "b"}, "name": "no"}, {"name": "a"}, {"name": 3}, "x", {"function": "f", "name": "c"}, {"name": "a"}], "messages": [{"role": "system", "content": "one"}, {"role": "user", "content": "u"}, {"role": "system"}, {"role": "system", "content": "two"}, 7]}
    df = spark.createDataFrame([(json.dumps(doc),), ("{}",), ("bad",), (None,), ('{"tools": 3, "messages": "x"}',)], "d string")
    got = df.select(walks.tool_names(F.col("d")).alias("t"), walks.system_text(F.col("d")).alias("s")).collect()
    assert (got[0]["t"], got[0]["s"]) == (["a", "b", "c"], "one\n\ntwo")
    assert [(r["t"], r["s"]) for r in got[1:]] == [([], "")] * 4


def test_reports(spark):
    good = {"pipeline": "p", "width": "640", "used": None, "warnings": ["w" * 600, 5], "counts": {"a": "2", "b": None}, "regions": [{"x1": 1, "y1": 2, "x2": 3, "y2": 4, "labels": ["l" * 200], "sources": [], "score": 1}]}
    bad = [("pipeline", "q"), ("width", 0), ("width", 2.5), ("width", "x"), ("used", -1), ("used", "inf?"), ("warnings", "text"), ("counts", {"a b": 1}), ("counts", {"a": "x"}), ("counts", [1]), ("regions", [{"x1": 1}]), ("regions", {}), ("regions", [7])]
    docs = [(0, json.dumps(good)), (1, "x"), (2, None)] + [(10 + i, json.dumps(good | {k: v})) for i, (k, v) in enumerate(bad)]
    got = {r["id"]: r for r in walks.normalised_reports(spark.createDataFrame(docs, "id int, r string"), "id", "r", {"pipeline": "p"}, ("width",), ("used",), ("warnings",), ("counts",), ("regions",)).collect()}
    r = got[0]
    assert r["problem"] is None and r["numbers"] == {"width": 640.0, "used": 0.0} and r["amounts"] == {"counts": {"a": 2.0, "b": 0.0}}
    assert r["texts"] == {"warnings": ["w" * 500, "5"]} and r["regions"]["regions"][0]["label"] == "UNKNOWN" and len(r["regions"]["regions"][0]["labels"][0]) == 120
    assert got[1]["problem"] == got[2]["problem"] == "report" and got[1]["numbers"] is None
    assert [got[10 + i]["problem"] for i in range(len(bad))] == [k for k, _ in bad]


@pytest.mark.parametrize(("length", "stride"), [(8, 3), (5, 0), (100, 10), (4, 3)])
def test_windows_cover_every_token(spark, length, stride):
    rnd = random.Random(length)
    rows = [(i, " ".join("w" * rnd.randrange(1, 5) for _ in range(rnd.randrange(0, 40)))) for i in range(30)] + [(30, None), (31, " \n")]
    cut = windows.cut(spark.createDataFrame(rows, "record_index int, text string"), max_length=length, stride=stride)
    out = cut.collect()
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"\S+", t or "")]
        own = sorted((r for r in out if r["record_index"] == i), key=lambda r: r["window"])
        assert [r["window"] for r in own] == list(range(max(1, -(-(len(spans) - stride) // (length - stride)))))
        assert {r["first"] + k: (x["start"], x["end"]) for r in own for k, x in enumerate(r["tokens"])} == dict(enumerate(spans))
        assert all(len(r["tokens"]) <= length for r in own)
    with pytest.raises(ValueError):
        windows.cut(cut, "text", 3, 3)


def test_labels_of_windows_are_those_of_the_text(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["Ann", "Lee", "pays", "in", "Rome"]) for _ in range(50))) for i in range(10)]
    gold = [(i, a, a + rnd.randrange(3, 15), rnd.choice(["NAME", "CITY"])) for i, t in rows for a in range(2, len(t) - 20, 25)]
    texts, spans = spark.createDataFrame(rows, "record_index int, text string"), spark.createDataFrame(gold, "record_index int, start int, end int, label string")

    def labels(length, stride):
        t = windows.token_rows(windows.cut(texts, max_length=length, stride=stride))
        aligned = evaluate.align_offsets(t.select("record_index", "start", "end").distinct(), spans)
        each = t.join(aligned, ["record_index", "start", "end"])
        return sorted(tuple(r) for r in windows.merged(each, "record_index").collect())

    assert labels(9, 4) == labels(1000, 0)
    scores = windows.token_rows(windows.cut(texts, max_length=9, stride=4)).select("record_index", "start", "end", F.array(F.col("number").cast("double"), F.lit(0.5)).alias("scores"))
    merged = evaluate.merged_probabilities(scores)
    assert merged.count() == 500 and merged.where("scores[1] <> 0.5").count() == 0
