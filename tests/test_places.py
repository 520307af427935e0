"""Spatial joins, fusion and association against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.functions import cues
from spanveil.operators import boxes, evaluate, grid

BOX = "frame_id long, id long, x1 double, y1 double, x2 double, y2 double"


def made(seed, n, frames=3):
    rnd, out = random.Random(seed), []
    for i in range(n):
        size = rnd.choice([2, 5, 20, 100, 700])
        x, y = rnd.choice([rnd.uniform(-50, 900), float(rnd.randrange(0, 900, 16))]), rnd.choice([rnd.uniform(-50, 600), float(rnd.randrange(0, 600, 16))])
        out.append((rnd.randrange(frames), i, x, y, x + rnd.choice([size, rnd.uniform(0, size), 16.0]), y + rnd.choice([size, rnd.uniform(0, size), 16.0])))
    nan = float("nan")
    return out + [(0, n, 5.0, 5.0, 5.0, 9.0), (0, n + 1, None, 1.0, 2.0, 2.0), (0, n + 2, nan, 1.0, 2.0, 2.0), (0, n + 3, 0.0, 0.0, float("inf"), 9.0), (None, n + 4, 0.0, 0.0, 9.0, 9.0), out[0][:1] + (n + 5,) + out[0][2:]]


def usable(b, least):
    return b[0] is not None and all(v is not None and v == v and abs(v) < 1e300 for v in b[2:]) and b[4] - b[2] >= least and b[5] - b[3] >= least


@pytest.mark.parametrize("touch", [False, True])
def test_pairs(spark, touch):
    a, b = made(1, 150), made(2, 130)
    got = grid.pairs(spark.createDataFrame(a, BOX).repartition(3), spark.createDataFrame(b, BOX), touch=touch).select("l.id", F.col("r.id").alias("o")).collect()
    least = 0 if touch else 1e-300
    meet = (lambda p, q: p <= q) if touch else (lambda p, q: p < q)
    want = {(p[1], q[1]) for p in a for q in b if usable(p, least) and usable(q, least) and p[0] == q[0] and meet(p[2], q[4]) and meet(q[2], p[4]) and meet(p[3], q[5]) and meet(q[3], p[5])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert grid.pairs(spark.createDataFrame([], BOX), spark.createDataFrame(b, BOX)).count() == 0


def share(p, q, kind):
    w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
    i, area = max(0, w) * max(0, h), lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return i / area(p) if kind == "coverage" else i / min(area(p), area(q))


def test_best_partner(spark):
    a, b = made(3, 120), made(4, 120)
    for kind, found in (("coverage", boxes.best_coverage(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX))), ("overlap", boxes.best_overlap(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), least=0.3))):
        rows = {r["id"]: r for r in found.collect()}
        assert len(rows) == len(a)
        for p in filter(lambda p: usable(p, 1e-300), a):
            s, o = max(((share(p, q, kind), -q[1]) for q in b if usable(q, 1e-300) and q[0] == p[0]), default=(0, None))
            if kind == "coverage":
                assert rows[p[1]]["coverage"] == pytest.approx(s) and (s == 0 or rows[p[1]]["region_id"] == -o)
            else:
                assert (rows[p[1]]["annotation_id"], rows[p[1]]["overlap"] or 0) == ((-o, pytest.approx(s)) if s >= 0.3 else (None, 0))


def test_a_frame_of_very_many_boxes(spark):
    n = 100_000
    r = spark.range(n).select(F.lit(1).alias("frame_id"), "id", (F.rand(1) * 30_000).alias("x1"), (F.rand(2) * 30_000).alias("y1"))
    r = r.withColumn("x2", F.col("x1") + 10).withColumn("y2", F.col("y1") + 10).checkpoint()
    got = grid.pairs(r, r)
    assert n < got.count() < 2 * n


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def scene(spark, n=150):
    """Frames, true boxes and regions with classes, labels, sources and paths."""
    c = F.pmod("id", F.lit(3)).cast("int")
    pick = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), c + 1)
    t = spark.createDataFrame(made(11, n), BOX).withColumns({"class": pick("NAME", "CARD_NUMBER", "SECRET"), "source_class": pick("NAME", "CARD_NUMBER", "API_KEY")})
    grown = {k: F.col(k) + (F.lit(d) if k in ("x2", "y2") else F.lit(-d)) for k, d in (("x1", 2), ("y1", 2), ("x2", 2), ("y2", 2))}
    r = t.where("id % 4 > 0").withColumns(grown).withColumns({"labels": F.array(pick("GIVEN_NAME", "EMAIL", "SECRET")), "sources": F.array(pick("OCR", "VISUAL", "OCR"), F.lit("OCR")), "path": pick("visual", "ocr", "fused")}).drop("class", "source_class")
    frames = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (9, "c")], "frame_id long, page_type string").withColumns({"width": F.lit(900), "height": F.lit(600)})
    return frames, t, r


REPORTS = {
    "totals": lambda f, t, r: evaluate.region_totals(f, t, r),
    "classes": lambda f, t, r: evaluate.by_class(t, r),
    "sources": lambda f, t, r: evaluate.by_source(t, r),
    "detector": lambda f, t, r: evaluate.detector_report(f, t, r),
    "paths": lambda f, t, r: evaluate.path_saves(t, r),
    "overlap": lambda f, t, r: boxes.best_overlap(r.drop("labels", "sources"), t),
    "association": lambda f, t, r: boxes.associate(t, r),
}


@pytest.mark.parametrize("name", REPORTS)
def test_small_frames_are_not_dealt_to_tiles(spark, monkeypatch, name):
    # a box was dealt to its tiles of every level, several rows of each; a frame of few boxes needs none
    given = scene(spark)
    whole = REPORTS[name](*given)
    assert "sequence(" not in plan(whole)
    want = sorted(map(repr, whole.collect()))
    for few in (0, 90):  # all frames by tiles; some
        monkeypatch.setattr(grid, "FEW", few)
        assert sorted(map(repr, REPORTS[name](*given).collect())) == want
        monkeypatch.setattr(grid, "BROADCAST_ROWS", 0)


def test_pairs_of_a_full_frame_are_not_sorted_for_their_best(spark, monkeypatch):
    monkeypatch.setattr(grid, "FEW", 0)
    a, b = spark.createDataFrame(made(3, 60), BOX), spark.createDataFrame(made(4, 60), BOX)
    assert "SortAggregate" not in plan(boxes.best_overlap(a, b))
    # small boxes, of one level, and one wide one: no rows at the levels between
    rows = [(1, i, float(i), 0.0, i + 10.0, 10.0) for i in range(50)] + [(1, 50, 0.0, 0.0, 3000.0, 5.0)]
    c = spark.createDataFrame(rows, BOX)
    dealt = []
    monkeypatch.setattr(grid, "_dealt", lambda *x, old=grid._dealt: dealt.append(old(*x)) or dealt[-1])
    assert grid.pairs(c, c).count() == sum(p[2] < q[4] and q[2] < p[4] for p in rows for q in rows)
    assert dealt[0].where("_l_id < 50").count() <= 50 * 3


def test_packed_scores_keep_their_order(spark):
    rnd = random.Random(1)
    scores = [0.0, 1.0, 0.5, 1 / 3, 2.0**-900, 1 - 2.0**-53, 2.0**-7, 0.98, 7.5] + [rnd.random() ** rnd.choice([1, 9, 40]) for _ in range(300)]
    rows = [(x, n) for x in scores for n in (-5, 0, 2**62, -(2**62))]
    got = spark.createDataFrame(rows, "s double, n long").withColumn("p", grid._packed(F.col("s"), F.col("n"))).select("*", grid._score(F.col("p")).alias("s2"), grid._number(F.col("p")).alias("n2")).collect()
    assert all((r["s"], r["n"]) == (r["s2"], r["n2"]) for r in got)
    assert [(r["s"], r["n"]) for r in sorted(got, key=lambda r: r["p"])] == sorted(rows, key=lambda r: (r[0], -r[1]))


@pytest.mark.parametrize("few", [0, 90])
def test_tiles_find_what_frames_find(spark, monkeypatch, few):
    monkeypatch.setattr(grid, "FEW", few)
    test_pairs(spark, False)
    test_pairs(spark, True)
    test_best_partner(spark)
    test_outside(spark)


def test_outside(spark):
    a, b = made(5, 150), made(6, 6)
    got = {r["id"] for r in boxes.outside_rois(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)).collect()}
    for p in filter(lambda p: usable(p, 0), a):
        x, y = (p[2] + p[4]) / 2, (p[3] + p[5]) / 2
        inside = any(q[0] == p[0] and q[2] <= x <= q[4] and q[3] <= y <= q[5] for q in b if usable(q, 0))
        assert (p[1] not in got) == inside


def merged(rects):
    """Regions by the rule as it is told: in order, each takes what it meets, then what the union meets, until nothing."""

    def meets(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return False
        area = [(r[2] - r[0]) * (r[3] - r[1]) for r in (a, b)]
        return w * h / max(1, sum(area) - w * h) >= 0.35 or w * h / max(1, min(area)) >= 0.55

    row = []  # (box, members)
    for n, rect in enumerate(rects):
        box, own, again, first = rect, [n], True, True
        while again:
            again, rest = False, []
            for other, theirs in row[::-1]:
                if meets(rect if first else box, other):
                    box = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
                    own, again = own + theirs, True
                else:
                    rest.append((other, theirs))
            row, first = rest[::-1], False
        row.append((box, own))
    return [own for _, own in row]


@pytest.mark.parametrize("seed", range(40))
def test_fusion(seed):
    rnd = random.Random(seed)
    rects = []
    for _ in range(rnd.randrange(60)):
        x, y = rnd.randrange(60), rnd.randrange(60)
        rects.append((float(x), float(y), float(x + rnd.randrange(0, 30)), float(y + rnd.randrange(0, 30))))
    assert boxes.fused_groups(np.array(rects).reshape(-1, 4)) == merged(rects)


def test_contextual_regions(spark):
    rows = [(1, 1, 10.0, 10.0, 110.0, 20.0, "Deliver to Ann Lee", 0.99), (1, 2, 0.0, 0.0, 50.0, 10.0, "Hello, Bo Dyk ", None), (1, 3, 0.0, 0.0, 50.0, 10.0, "Hello Team", 0.9), (1, 4, 0.0, 0.0, 0.0, 10.0, "Hello Ann", 0.9), (1, 5, 0.0, 0.0, 1.0, 1.0, None, 0.9)]
    got = sorted(tuple(r) for r in boxes.contextual_regions(spark.createDataFrame(rows, BOX + ", text string, ocr_confidence double")).collect())
    assert [(r[1], r[2], round(r[7], 2)) for r in got] == [(1, "ADDRESS", 0.96), (1, "NAME", 0.96), (2, "NAME", 0.5)]
    assert got[0][3:7] == (10.0, 10.0, 135.0, 30.0) and got[2][3:7] == (-2.0, -2.0, 52.0, 12.0)
    assert got[1][3] == pytest.approx(10 + 100 / 18 * 11 - 4)


def test_valued_regions(spark):
    rows = [(1, 1, 0.0, 0.0, 50.0, 12.0, "Email:", 0.9), (1, 2, 60.0, 0.0, 150.0, 12.0, "bob@x.org", 0.7), (2, 1, 0.0, 0.0, 50.0, 12.0, "Email:", 0.9)]
    r = spark.createDataFrame(rows, BOX + ", text string, ocr_confidence double")
    got = boxes.valued(boxes.associate_regions(r, ["EMAIL"]), r).collect()
    assert [(x["frame_id"], x["cue_id"], x["value_id"], x["label"], x["x1"], x["score"]) for x in got] == [(1, 1, 2, "EMAIL", 60.0, 0.7)]


def test_shapes_of_values(spark):
    cases = [("EMAIL", "a@b", True), ("EMAIL", "a b@c.d", False), ("PHONE", "555-0136", True), ("PHONE", "12345", False), ("NAME", "Ann O’Neil", True), ("NAME", "a1", False), ("ADDRESS", "5th", True), ("ADDRESS", "Elm Street", True), ("ADDRESS", "Elm", False), ("CARD_NUMBER", "4" * 12, True), ("CARD_NUMBER", "4" * 20, False), ("CVC", "1 23", True), ("CVC", "123x", False), ("DOB", "1/2/1990", True), ("DOB", "in 1990", True), ("DOB", "x", False), ("GOVERNMENT_ID", "A1234", True), ("BANK_ACCOUNT", "GB82WESTABCD", True), ("BANK_ACCOUNT", "12345", False), ("OTHER", "abcd", True), ("OTHER", "abc", False), ("NAME", "Submit", False), ("NAME", None, False), (None, "abcd", True)]
    d = spark.createDataFrame(cases, "label string, t string, want boolean")
    assert [r for r in d.withColumn("got", cues.plausible(F.col("label"), F.col("t"))).where("got <> want or got is null").collect()] == []
