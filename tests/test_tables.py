"""Boxes, evaluation, curation, ledgers and sources against literal examples and plain models."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil.functions import geometry as geo
from spanveil.operators import boxes, curate, evaluate, ledger
from spanveil.sources import files, synthetic

BOX = "frame_id string, id int, x1 double, y1 double, x2 double, y2 double"


def test_nms_is_class_aware(spark):
    r = spark.createDataFrame([("f", i, 10.0, 10.0, 50.0, 50.0, c, s) for i, (c, s) in enumerate([(1, 0.9), (1, 0.8), (4, 0.7)])], BOX + ", class_id int, score double")
    assert {(x["class_id"], x["score"]) for x in boxes.suppress(r).collect()} == {(1, 0.9), (4, 0.7)}


def test_fusion_joins_labels(spark):
    rows = [("f", 1, 100.0, 20.0, 220.0, 50.0, ["CARD"], ["VISUAL"], 0.9), ("f", 2, 40.0, 15.0, 300.0, 55.0, ["NAME", "EMAIL"], ["OCR", "RULE"], 0.8), ("f", 3, 500.0, 500.0, 510.0, 510.0, ["X"], ["OCR"], 0.5)]
    out = boxes.fuse(spark.createDataFrame(rows, BOX + ", labels array<string>, sources array<string>, score double")).orderBy("idx").collect()
    assert [(x["x1"], x["y1"], x["x2"], x["y2"]) for x in out] == [(40.0, 15.0, 300.0, 55.0), (500.0, 500.0, 510.0, 510.0)]
    assert out[0]["labels"] == ["NAME", "EMAIL", "CARD"] and out[0]["sources"] == ["OCR", "RULE", "VISUAL"] and out[0]["score"] == 0.9


def test_coverage_and_letterbox(spark):
    b = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    r = spark.range(1).select(geo.coverage(b(5, 5, 25, 25), b(10, 10, 20, 20)), geo.coverage(b(10, 10, 15, 20), b(10, 10, 20, 20)), geo.letterbox(F.lit(1600), F.lit(280))).first()
    assert r[0] == 1.0 and r[1] == 0.5
    assert (round(r[2]["scale"], 6), r[2]["width"], r[2]["height"], r[2]["pad_x"], r[2]["pad_y"]) == (0.4, 640, 112, 0, 264)


def test_region_totals(spark):
    frames = spark.createDataFrame([("a", 100, 100, "p"), ("b", 100, 100, "q")], "frame_id string, width int, height int, page_type string")
    truth = spark.createDataFrame([("a", 1, 10.0, 10.0, 20.0, 20.0, "CARD_NUMBER", "CARD_NUMBER"), ("a", 2, 50.0, 50.0, 60.0, 60.0, "CVC", "CVC")], BOX + ", class string, source_class string")
    regions = spark.createDataFrame([("a", 1, 5.0, 5.0, 25.0, 25.0, ["CREDIT_CARD"], ["V"]), ("b", 1, 0.0, 0.0, 9.0, 9.0, ["X"], ["V"])], BOX + ", labels array<string>, sources array<string>")
    r = evaluate.region_totals(frames, truth, regions).first()
    assert (r["recall"], r["secret_misses"], r["proposal_precision"], r["hard_negative_pass_rate"]) == (0.5, 1, 0.5, 0.0)
    checks = evaluate.gates(evaluate.region_totals(frames, truth, regions), [("recall", ">=", 0.97), ("secret_misses", "<=", 1)])
    assert evaluate.all_passed(checks).first()["failed"] == ["recall"]


def test_threshold_choice_matches_a_plain_sweep(spark):
    rnd = random.Random(2)
    rows = [(round(rnd.random(), 3), rnd.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, truth boolean")
    got = {round(r["threshold"], 2): (r["true_positive"], r["false_positive"], r["false_negative"]) for r in evaluate.threshold_sweep(df).collect()}
    for k in range(91):
        t = (5 + k) / 100
        assert got[t] == (sum(y for s, y in rows if s >= t), sum(not y for s, y in rows if s >= t), sum(y for s, y in rows if s < t))
    assert evaluate.choose_threshold(evaluate.threshold_sweep(df), 0.9).first()["met_target"]


def test_greedy_match_and_association(spark):
    t = spark.createDataFrame([("f", 1, 0.0, 0.0, 10.0, 10.0, 0), ("f", 2, 100.0, 0.0, 110.0, 10.0, 0)], BOX + ", class_id int")
    d = spark.createDataFrame([("f", 7, 0.0, 0.0, 10.0, 9.0, 0, 0.9), ("f", 8, 0.0, 0.0, 10.0, 10.0, 0, 0.8), ("f", 9, 100.0, 0.0, 110.0, 10.0, 1, 0.7)], BOX + ", class_id int, score double")
    assert [(r["truth_id"], r["detection_id"]) for r in boxes.greedy_match(t, d).collect()] == [(1, 8)]
    c = spark.createDataFrame([("f", 1, 0.0, 0.0, 50.0, 10.0), ("f", 2, 0.0, 40.0, 50.0, 50.0)], BOX)
    v = spark.createDataFrame([("f", 5, 60.0, 0.0, 90.0, 10.0), ("f", 6, 0.0, 55.0, 40.0, 65.0)], BOX)
    assert {(r["cue_id"], r["value_id"]) for r in boxes.associate(c, v).collect()} == {(1, 5), (2, 6)}


def test_entity_pairs_and_scores(spark):
    s = "doc_id int, start int, end int, label string"
    t = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "B"), (2, 0, 3, "A")], s)
    p = spark.createDataFrame([(1, 0, 5, "A"), (1, 11, 15, "A"), (3, 0, 2, "C")], s)
    assert {(r["doc_id"], r["truth_class"], r["predicted_class"]) for r in evaluate.entity_pairs(t, p).collect()} == {(1, "A", "A"), (1, "B", "A"), (2, "A", None), (3, None, "C")}
    assert {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.entity_scores(t, p).collect()} == {"A": (1, 1, 1), "B": (0, 0, 1), "C": (0, 1, 0)}


def test_windows_and_labels(spark):
    w = spark.createDataFrame([(0, 0, 3, [0.2, 0.7]), (0, 0, 3, [0.9, 0.1]), (0, 4, 6, [0.8, 0.1]), (0, 7, 9, [0.1, 0.2])], "record_index int, start int, end int, scores array<double>")
    got = evaluate.label_sequence(evaluate.merged_probabilities(w), ["X", "Y"]).orderBy("start").collect()
    assert [r["label"] for r in got] == ["B-X", "I-X", "O"]
    gold = spark.createDataFrame([(0, 0, 6, "N")], "record_index int, start int, end int, label string")
    assert [r["label"] for r in evaluate.align_offsets(w.select("record_index", "start", "end").distinct(), gold).orderBy("start").collect()] == ["B-N", "I-N", "O"]


def test_incumbent_fold(spark):
    e = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.95, 0.4), (3, 0.93, 0.9), (4, 0.945, 0.8), (5, 0.96, 0.9)], "epoch int, secret_recall double, score double")
    assert [(r["epoch"], r["taken"], r["best_epoch"]) for r in evaluate.incumbent(e).orderBy("epoch").collect()] == [(1, True, 1), (2, False, 1), (3, False, 1), (4, True, 4), (5, True, 5)]


def test_curation(spark):
    v = spark.createDataFrame([("a", "train", "E", "x"), ("b", "holdout", "E", "x"), ("c", "holdout", "E", "y")], "id string, split string, label string, canonical string")
    assert {r["id"] for r in curate.without_leakage(v, v).collect()} == {"a", "c"}
    d = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 3, None)], "k string, n int, s string")
    assert {tuple(r) for r in curate.first_of(d, "k", ["n"]).collect()} == {("k", 1, "a"), ("m", 3, None)}
    assert [r["id"] for r in curate.evenly(spark.range(10), "id", 4).orderBy("id").collect()] == [i * 10 // 4 for i in range(4)]
    assert curate.evenly(spark.range(0), "id", 4).count() == 0
    assert {tuple(r) for r in curate.summary(d.select("k"), ["k"]).collect()} == {("k", "k", 2), ("k", "m", 1)}
    assert curate.key_parity(spark.range(3), spark.range(1, 4), "id").count() == 2


def test_synthetic_records_are_valid_and_disjoint(spark):
    r = synthetic.records(spark, "train", 60, noise=0.3)
    assert curate.violations(r, ["NAME", "EMAIL", "PHONE", "API_KEY"]).count() == 0
    assert r.where("noisy").count() > 0
    emails = lambda s: synthetic.records(spark, s, 60).select(F.explode("spans.value").alias("v")).where("v like '%@%'")
    assert emails("train").intersect(emails("holdout")).count() == 0


def test_ledger(spark):
    t = spark.createDataFrame([(1, s, k) for s, k in enumerate(["ok", "error", "error", "ok", "error", "ok"] + ["ok"] * 8 + ["error"])], "run int, step int, kind string")
    assert [r["step"] for r in ledger.trailing(t, "run", "step", "kind").where("review").orderBy("step").collect()] == [4, 5, 6, 7, 8]
    assert [r["step"] for r in ledger.cooled_down(spark.createDataFrame([(1, s) for s in (4, 5, 12, 13, 25)], "run int, step long"), "run", "step").orderBy("step").collect()] == [4, 12, 25]
    assert ledger.ring(t, "run", "step", 3).count() == 3
    m = spark.createDataFrame([("go ⟦TOOL:sort:A_1_0000,B_2_0000:x1:by name⟧ ⟦TOOL:echo::y⟧",)], "t string").select(ledger.markers(F.col("t")).alias("m")).first()["m"]
    assert [(x["verb"], x["tokens"], x["id"], x["instruction"]) for x in m] == [("sort", ["A_1_0000", "B_2_0000"], "x1", "by name"), ("echo", [], "y", None)]


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([(1, 'data: {"model":"m","choices":[{"delta":{"content":"Hel"}}]}\n\ndata: {"choices":[{"delta":{"content":"lo"},"finish_reason":"stop"}]}\n\ndata: [DONE]\n'), (2, 'data: {"choices":[{"delta":{"content":"x"}}]}\n')], "id int, value string")
    got = {r["id"]: (r["content"], r["complete"]) for r in files.sse_completion(raw, "id").collect()}
    assert got == {1: ("Hello", True), 2: ("x", False)}
    lsof = spark.createDataFrame([(i, v) for i, v in enumerate(["p12", "cpython", "n127.0.0.1:80->127.0.0.1:9", "nlocalhost:1", "p13", "n8.8.8.8:53"])], "at int, value string")
    assert [tuple(r) for r in files.lsof_connections(lsof).collect()] == [(12, "python", "127.0.0.1:80", "127.0.0.1:9"), (12, "python", "localhost:1", None), (13, None, "8.8.8.8:53", None)]
    lines = spark.createDataFrame([("a.txt", "1 0.5 0.5 0.2 0.4")], "file string, line string")
    assert tuple(round(x, 6) if isinstance(x, float) else x for x in files.yolo_rows(lines, 2).first()) == ("a.txt", 1, 0.4, 0.3, 0.6, 0.7)
    with pytest.raises(Exception, match="bad label line"):
        files.yolo_rows(spark.createDataFrame([("a.txt", "9 0.5 0.5 0.2 0.4")], "file string, line string"), 2).collect()
    p = str(tmp_path / "x")
    assert files.write_jsonl(spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string"), p).first()["records"] == 2
    assert files.read_jsonl(spark, p, "i int, s string", strict=True).count() == 2


def test_recogniser_noise(spark):
    from spanveil.sources import synthetic

    text = "Old Bill Sold 10 lOllIpops to B " * 40
    spans = [(0, 3, "A"), (4, 8, "B"), (30, 31, "C"), (100, 140, "D")]
    rows = [(f"k{i}", text, spans) for i in range(20)] + [("n", None, None), ("e", "", []), ("s", " \n ", None), ("v", "o", [(0, 1, "A")])]
    kind = "k string, t string, s array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame(rows, kind)
    out = {r["k"]: r["n"] for r in df.select("k", synthetic.noised(F.col("t"), F.col("s"), F.col("k"), 0.5, 0.1).alias("n")).collect()}
    assert len({n["text"] for k, n in out.items() if k[0] == "k"}) == 20
    for k, n in out.items():
        if k[0] == "k":
            back = list(text)
            for o in n["operations"]:
                assert back[o["index"]] == o["was"] and (o["op"] == "replace") == (o["becomes"] != "")
                back[o["index"]] = o["becomes"]
            assert "".join(back) == n["text"]
            for (a, b, label), s in zip(spans, n["spans"], strict=True):
                assert s["label"] == label and s["value"] == n["text"][s["start"] : s["end"]] == "".join(back[a:b]) != ""
            assert " " in n["text"]
    assert out["n"]["text"] is None and (out["e"]["text"], out["s"]["text"]) == ("", " \n ") and out["v"]["text"] in ("o", "0")
    same = df.select(synthetic.noised(F.col("t"), F.col("s"), F.col("k"), 0.0, 0.0)["text"].alias("t"), F.col("t").alias("w")).where("NOT t <=> w")
    assert same.count() == 0
