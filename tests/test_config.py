"""Configuration documents, deep contracts, label rows and injected instructions."""

import json

import pytest
from pyspark.sql import functions as F

from spanveil.operators import checks
from spanveil.sources import config


def put(tmp_path, name, value):
    f = tmp_path / name
    f.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
    return str(f)


def test_policy(spark, tmp_path):
    got = {r["pii_class"]: r["level"] for r in config.read_policy(spark, put(tmp_path, "p.json", {"email": "blocked", "New Class": "approval"})).collect()}
    assert (got["EMAIL"], got["NEW_CLASS"], got["NAME"], got["SSN"]) == ("blocked", "approval", "hide_use", "blocked")
    for bad, told in (("[1]", "no JSON object"), ("{x", "no JSON object"), ({"EMAIL": 3}, "EMAIL is no text"), ({"EMAIL": "maybe"}, "EMAIL has no level maybe")):
        with pytest.raises(ValueError, match=told):
            config.read_policy(spark, put(tmp_path, "bad.json", bad))


def test_criteria(spark, tmp_path):
    good = {"version": 1, "classes": {" email ": " care "}, "global_rules": ["a ", "b"], "trace_review": {"window_steps": 5}}
    r = config.read_criteria(spark, put(tmp_path, "c.json", good)).first()
    assert (r["guidance"], r["rules"], r["threshold"], r["window"]) == ({"EMAIL": "care"}, ["a", "b"], 3, 5)
    assert config.read_criteria(spark, put(tmp_path, "d.json", {"version": 1})).first()["window"] == 8
    bad = [({"version": 2}, "version"), ({"classes": {"ODD": "x"}}, "unknown class ODD"), ({"classes": {"EMAIL": " "}}, "guidance"), ({"classes": [1]}, "classes is no object"), ({"global_rules": ["x" * 501]}, "global rule"), ({"global_rules": ["x"] * 21}, "global_rules"), ({"global_rules": "x"}, "global_rules"), ({"trace_review": {"window_steps": 0}}, "window_steps"), ({"trace_review": {"denied_resolution_threshold": "3"}}, "threshold"), ({"trace_review": 3}, "trace_review")]
    for more, told in bad:
        with pytest.raises(ValueError, match=told):
            config.read_criteria(spark, put(tmp_path, "bad.json", good | more))


def test_labels(spark, tmp_path):
    good = {"labels": ["O", "B-A", "I-A"], "entity_classes": ["A"], "secret_classes": [], "contextual_classes": ["A"]}
    assert config.read_labels(spark, put(tmp_path, "l.json", good)).first()["labels"] == ["O", "B-A", "I-A"]
    for more, told in (({"labels": ["O", "I-A", "B-A"]}, "in order"), ({"secret_classes": None}, "no list of secret_classes")):
        with pytest.raises(ValueError, match=told):
            config.read_labels(spark, put(tmp_path, "bad.json", good | more))


def test_deep_contract(spark):
    doc = {"classes": ["A", "B"], "n": 3, "deep": {"flag": False, "hash": "a" * 64, "zero": 0, "text": "2"}}
    need = [("classes", "=", '["A","B"]'), ("classes", "=", '["B","A"]'), ("n", ">=", "2"), ("n", ">=", "4"), ("deep.flag", "=", "false"), ("deep.hash", "sha256", ""), ("deep.text", ">=", "1"), ("deep.zero", "=", "0"), ("deep.none", "=", "true"), ("n", "sha256", "")]
    got = checks.deep_contract(spark.createDataFrame([(1, json.dumps(doc)), (2, "bad")], "id int, m string"), "id", "m", need).collect()
    assert [r["passed"] for r in got if r["id"] == 1] == [True, False, True, False, True, True, False, True, False, False]
    assert not any(r["passed"] for r in got if r["id"] == 2)


def test_label_rows(spark):
    note = lambda box, c="B": {"class": c, "bbox_xyxy": box}
    ok = [10.0, 10.0, 20.0, 20.0]
    cases = [("1 .5 .5 .1 .1", note(ok), None), ("1 .5 .5 .1", note(ok), "format"), ("x .5 .5 .1 .1", note(ok), "numeric"), ("1 .5 nan .1 .1", note(ok), "numeric"), ("0 .5 .5 .1 .1", note(ok), "class"), ("1 1.5 .5 .1 .1", note(ok), "range"), ("1 .5 .5 0 .1", note(ok), "range"), ("1 .5 .5 .1 .1", note([1.0]), "bbox"), ("1 .5 .5 .1 .1", note([0.0, 0.0, 101.0, 5.0]), "outside"), ("1 .5 .5 .1 .1", note([5.0, 0.0, 5.0, 5.0]), "outside"), ("1 .5 .5 .1 .1", note([5.0, 0.0, float("nan"), 5.0]), "number"), ("2 .5 .5 .1 .1", note(ok, "Z"), "class")]
    kind = "id int, lines array<string>, annotations array<struct<class:string,bbox_xyxy:array<double>>>, width int, height int"
    rows = [(i, [line], [a], 100, 100) for i, (line, a, _) in enumerate(cases)] + [(99, ["1 .5 .5 .1 .1"] * 2, [note(ok)], 100, 100)]
    got = {(r["id"], r["line"]): r["problem"] for r in checks.label_file_problems(spark.createDataFrame(rows, kind), "id", ["A", "B"]).collect()}
    assert got == {(i, 1): p for i, (_, _, p) in enumerate(cases) if p} | {(99, 0): "count"}


def test_instructions_are_injected_once(spark):
    kind = "id int, m array<struct<role:string,content:string>>"
    rows = [(1, [("user", "hi"), ("system", "one \n"), ("system", ""), ("system", "two")]), (2, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]), (3, [("assistant", "x")]), (4, [("system", "open [B] never closed")]), (5, [])]
    put_ = lambda c: checks.with_instructions(c, "do it", "[B]", "[E]", "[P]")
    df = spark.createDataFrame(rows, kind).withColumn("once", put_(F.col("m"))).withColumn("twice", put_(F.col("once")))
    got = {r["id"]: r for r in df.collect()}
    assert [tuple(m) for m in got[1]["once"]] == [("system", "one\n\ntwo\n\n[B]\ndo it\n[E]"), ("user", "hi")]
    assert [tuple(m) for m in got[2]["once"]] == [("user", "a"), ("assistant", "b"), ("user", "c\n\n[B]\ndo it\n[E]"), ("assistant", "d")]
    assert [got[i]["once"] for i in (3, 4, 5)] == [None] * 3
    assert all(got[i]["twice"] == got[i]["once"] for i in got)


def test_unreadable_reports_are_not_cleared(spark):
    df = spark.createDataFrame([(1, '{"a": [{"text": 1}]}'), (2, "bad"), (3, '{"b": 1}')], "id int, r string")
    assert {tuple(r) for r in checks.forbidden_fields(df, "id", "r", ("text",)).collect()} == {(1, "$.a[0].text"), (2, "$")}
