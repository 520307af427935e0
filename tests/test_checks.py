"""Contract checks, log rules, fail-closed scrubbing, nested resolution."""

import json

import pytest
from pyspark.sql import functions as F

from spanveil.cluster import numbered
from spanveil.operators import boxes, checks, ledger, vault


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scrub_is_exact_for_null_repeated_and_clashing_keys(spark):
    rows = [(None, "mail bob@example.org now", 1), (7, "nothing at all to hide here", 2), (7, "longer text before kim@example.org", 3), (None, "card 4111 1111 1111 1111 and bob@example.org", 4), (8, None, 5), (9, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n int").withColumn("found", F.lit("f")).withColumn("row", F.lit("r"))
    out, kept = vault.scrub(docs)
    got = {r["n"]: (r["scrubbed"], r["n_replaced"], r["found"], r["row"]) for r in out.collect()}
    assert len(got) == 6 and all(v[2:] == ("f", "r") for v in got.values())
    assert got[1][0] == "mail EMAIL_1_0000 now" and got[2][:2] == ("nothing at all to hide here", 0)
    assert got[3][0] == "longer text before EMAIL_2_0000"
    assert got[4][0] == "card [BLOCKED_CARD_NUMBER] and EMAIL_1_0000" and got[4][1] == 2
    assert got[5][0] is None and got[6][0] == ""
    assert kept.count() == 2
    assert vault.leaks(out.select("doc_id", F.col("scrubbed").alias("text")), kept.select("value"), "doc_id").count() == 0


def test_numbered_follows_the_order(spark):
    df = spark.range(0, 1000).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("v")).repartition(7)
    got = [(r["v"], r["number"]) for r in numbered(df, "v").collect()]
    assert sorted(got) == [(v, i + 1) for i, v in enumerate(sorted(v for v, _ in got))]
    assert numbered(df.where("v < 0"), "v").count() == 0


def test_nested_tokens_are_resolved_in_texts_only(spark):
    kept = spark.createDataFrame([("EMAIL_1_ab12", 'a"b@x.org'), ("NAME_1_ab12", "Ann")], "placeholder string, value string")
    doc = {"to": "EMAIL_1_ab12", "NAME_1_ab12": ["NAME_1_ab12!", {"deep": [1, None, "EMAIL_1_ab12 EMAIL_1_ab12"]}]}
    rows = [(1, json.dumps(doc)), (2, json.dumps({"x": "NAME_2_ab12"})), (3, "no json NAME_1_ab12"), (4, None)]
    got = {r["k"]: r for r in checks.resolve_nested(spark.createDataFrame(rows, "k int, action string"), kept, "k").collect()}
    assert json.loads(got[1]["resolved"]) == {"to": 'a"b@x.org', "NAME_1_ab12": ["Ann!", {"deep": [1, None, 'a"b@x.org a"b@x.org']}]}
    assert got[2]["resolved"] == rows[1][1] and got[2]["unknown"] == ["NAME_2_ab12"]
    assert got[3]["resolved"] == rows[2][1] and got[4]["resolved"] is None


def test_log_lines_keep_no_secret(spark):
    lines = [
        ("\x1b[31m--- step\x1b[0m", ("runtime", "--- step")),
        ("user: my task", None),
        ("│ ──── │", None),
        ("click MY_TOKEN=abc here", ("action", "click MY_TOKEN=[REDACTED] here")),
        ("│ 💭 hm │", ("reasoning", "💭 hm")),
        ("it failed\x07", ("error", "it failed")),
        ("plain", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "i int, line string").select("i", ledger.log_line(F.col("line")).alias("l"))
    got = {r["i"]: r["l"] and tuple(r["l"]) for r in df.collect()}
    assert [got[i] for i in range(len(lines))] == [want for _, want in lines]
    long = _one(spark, ledger.log_line(F.lit("answer " + "x" * 3000))["text"])
    assert len(long) == 1998 and long.endswith("…")


def test_values_go_to_their_labels_by_place(spark):
    rows = [("f", 1, 0.0, 0.0, 50.0, 10.0, "Email"), ("f", 2, 60.0, 0.0, 160.0, 10.0, "no address"), ("f", 3, 200.0, 0.0, 300.0, 10.0, "a@b.org"), ("f", 4, 60.0, 0.0, 50.0, 10.0, "c@d.org"), ("f", 5, 60.0, 0.0, 90.0, 10.0, " ")]
    r = spark.createDataFrame(rows, "frame_id string, id int, x1 double, y1 double, x2 double, y2 double, text string")
    assert [(x["cue_id"], x["value_id"]) for x in boxes.associate_regions(r, ["EMAIL"]).collect()] == []  # 150 is beyond 12 times the height
    near = r.withColumn("x1", F.when(F.col("id") == 3, 165.0).otherwise(F.col("x1")))
    assert [(x["cue_id"], x["value_id"]) for x in boxes.associate_regions(near, ["EMAIL"]).collect()] == [(1, 3)]


def test_blocks_are_stripped_or_refused(spark):
    strip = lambda t: _one(spark, checks.strip_block(F.lit(t), "[A]", "[/A]", "[M]"))
    assert strip("x[A]1\n2[/A]y[A]3[/A]\n[M] z\nend \n") == "xy\nend"
    assert strip("x[A]open") is None and strip("[/A] x") == "[/A] x"


def test_unknown_engines_are_refused():
    with pytest.raises(ValueError):
        checks.engine("other")


def test_registered_tools(spark):
    assert checks.register(spark) == ["tool_collapse", "tool_digits", "tool_redact"]
    got = spark.sql("SELECT tool_digits('a1b2') AS a, tool_collapse('  x   y ') AS b, tool_redact('my token=abc x') AS c").first()
    assert tuple(got) == ("12", "x y", "my token=[REDACTED] x")


def test_answers_are_held_to_their_request(spark):
    def p(kind, values, got, n=None):
        returned = F.array(*map(F.lit, got)) if got is not None else F.lit(None).cast("array<string>")
        return _one(spark, checks.answer_problem(F.lit(kind), F.array(*map(F.lit, values)), returned, F.lit(n).cast("int")))

    assert p("sort", ["a", "b"], ["b", "a"]) is None and p("sort", ["a", "b"], ["b"]) == "missing"
    assert p("select", ["a", "b"], ["c"]) == "unknown" and p("select", ["a", "b"], ["a", "a"]) == "repeated"
    assert p("select", ["a", "b"], ["a"], 2) == "count" and p("select", ["a"], None) == "shape"
