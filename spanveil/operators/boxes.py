"""Operators on boxes of frames: suppression, fusion, association, coverage."""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import geometry as geo
from spanveil.functions import rules
from spanveil.operators import grid
from spanveil.operators.grouped import per_group, per_pair


def suppress(regions: DataFrame, frame: str = "frame_id", limit: float = 0.7, most: int = 300) -> DataFrame:
    """Class-aware non-maximum suppression: the best boxes of each frame and class of which none overlaps another by more than ``limit``.

    A fold over each group's boxes by falling score; ties go to the smaller id.
    """
    box = F.struct((-F.col("score")).alias("order"), F.col("id"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("score"))
    g = regions.groupBy(frame, "class_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    kept = F.aggregate("b", F.filter("b", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda k: geo.iou(k, x) > limit), acc).otherwise(F.concat(acc, F.array(x))))
    out = g.select(frame, "class_id", F.explode(kept).alias("k")).select(frame, "class_id", "k.id", "k.x1", "k.y1", "k.x2", "k.y2", "k.score")
    nth = F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("score"), "id"))
    return out.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


#: The share of the union, or of the smaller box (each of one pixel at least), from which two regions are one.
SAME, INSIDE = 0.35, 0.55


def _one(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the other boxes are one region with a box."""
    side = lambda b: np.maximum(0.0, b[..., 2:] - b[..., :2]).prod(-1)
    w = np.minimum(box[2:], others[:, 2:]) - np.maximum(box[:2], others[:, :2])
    i = np.maximum(0.0, w).prod(-1)
    a, b = side(box), side(others)
    return (i > 0) & ((i / np.maximum(1.0, a + b - i) >= SAME) | (i / np.maximum(1.0, np.minimum(a, b)) >= INSIDE))


def fused_groups(boxes: np.ndarray) -> list[list[int]]:
    """Which of ordered boxes become one region each, in order of joining.

    Regions stand in a row. A new box goes along it from the last to the first and takes
    what is one with it: once by itself, then with all that it has taken so far, again
    and again until a walk takes nothing; then it stands last.
    """
    hull, member = np.zeros((0, 4)), []
    for n, box in enumerate(np.asarray(boxes, float)):
        whole, own, alone = box.copy(), [n], True
        while True:
            at, taken = len(member), 0
            while len(hit := np.flatnonzero(_one(box if alone else whole, hull[:at]))):
                at = int(hit[-1])
                whole = np.append(np.minimum(whole[:2], hull[at, :2]), np.maximum(whole[2:], hull[at, 2:]))
                own += member.pop(at)
                hull = np.delete(hull, at, 0)
                taken += 1
            if not taken:
                break
            alone = False
        hull, member = np.vstack([hull, whole]), [*member, own]
    return member


def fuse(regions: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Regions of a frame that overlap enough as one, again and again until none do; labels and sources are joined in order of score.

    The result depends on the order, so each frame is one group.
    """
    kind = regions.schema[frame].dataType.simpleString()

    def run(f: object, rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (-r["score"], r["id"]))
        xy = np.array([[r["x1"], r["y1"], r["x2"], r["y2"]] for r in rows], float)
        out = []
        for group in fused_groups(xy):
            every = lambda c, g=group: list(dict.fromkeys(x for i in g for x in rows[i][c]))
            out.append((*xy[group, :2].min(0).tolist(), *xy[group, 2:].max(0).tolist(), every("labels"), every("sources"), max(rows[i]["score"] for i in group)))
        out.sort(key=lambda x: (x[1], x[0]))
        return [(f, i, *x[:4], " + ".join(x[4]), *x[4:]) for i, x in enumerate(out)]

    return per_group(regions, frame, run, f"{frame} {kind}, idx int, x1 double, y1 double, x2 double, y2 double, label string, labels array<string>, sources array<string>, score double")


def reading_order(findings: DataFrame, frame: str = "frame_id", slack: float = 10.0) -> DataFrame:
    """A place for each finding: rows by y (within ``slack`` of the row before), then x."""
    kind = findings.schema[frame].dataType.simpleString()

    def compare(a: dict, b: dict) -> float:
        return a["x1"] - b["x1"] if abs(a["y1"] - b["y1"]) <= slack else a["y1"] - b["y1"]

    def run(f: object, rows: list[dict]) -> list[tuple]:
        return [(f, r["id"], i) for i, r in enumerate(sorted(sorted(rows, key=lambda r: r["id"]), key=cmp_to_key(compare)))]

    return per_group(findings.select(frame, "id", "x1", "y1"), frame, run, f"{frame} {kind}, id long, place int")


def best_coverage(truth: DataFrame, regions: DataFrame, frame: str = "frame_id") -> DataFrame:
    """truth with the greatest coverage by any region of its frame, and that region (of equal ones the smallest id; the frame's first, if none covers any of it)."""
    found = grid.best(truth, regions, lambda t, r: geo.coverage(r, t), frame, "coverage", "region_id")
    first = regions.groupBy(F.col(frame).alias("_f")).agg(F.min("id").alias("_first"))
    return found.join(first, F.col(frame) == F.col("_f"), "left").withColumn("region_id", F.coalesce("region_id", "_first")).withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).drop("_f", "_first")


def covered(truth: DataFrame, regions: DataFrame, frame: str = "frame_id", share: float = 0.98) -> DataFrame:
    """truth with whether a region of its frame covers that share of it (``hit``)."""
    own = [frame, "x1", "y1", "x2", "y2"]
    rows = grid.found(truth, regions.select(*own), lambda t, r: geo.coverage(r, t) >= share, lambda r: F.lit(True), frame, "_by")
    return rows.withColumn("hit", F.lit(share <= 0) | F.coalesce(F.size("_by") > 0, F.lit(False))).drop("_by")


def best_overlap(regions: DataFrame, annotations: DataFrame, frame: str = "frame_id", least: float = 0.5) -> DataFrame:
    """regions with the annotation of their frame that they overlap most (the greater of both boxes' shares), if it is ``least`` or more; of equal ones the smallest id."""
    return grid.best(regions, annotations, grid.overlap, frame, "overlap", "annotation_id", least)


def masked_area(regions: DataFrame, frame: str = "frame_id", width: str = "width", height: str = "height") -> DataFrame:
    """The share of each frame under its regions, 1 at most; overlaps count twice."""
    a = geo.area(F.struct("x1", "y1", "x2", "y2"))
    return regions.groupBy(frame, width, height).agg(F.sum(a).alias("a")).select(frame, F.when(F.col(width) * F.col(height) > 0, F.least(F.lit(1.0), F.col("a") / (F.col(width) * F.col(height)))).otherwise(0.0).alias("masked_area"))


def _iou(a: dict, b: dict) -> float:
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h)


def greedy_match(truth: DataFrame, detections: DataFrame, frame: str = "frame_id", least: float = 0.5) -> DataFrame:
    """One detection at most for each true box: true boxes in order of id take the unused detection of their class with the greatest IoU, if it is ``least`` or more; of equal ones the later in order of falling score."""
    kind = truth.schema[frame].dataType.simpleString()

    def run(f: object, t: list[dict], d: list[dict]) -> list[tuple]:
        free = dict(enumerate(sorted(d, key=lambda r: (-r["score"], r["id"]))))
        out = []
        for x in sorted(t, key=lambda x: x["id"]):
            v, k = max(((_iou(x, r), k) for k, r in free.items() if r["class_id"] == x["class_id"]), default=(0.0, -1))
            if v >= least and k >= 0:
                out.append((f, x["id"], free.pop(k)["id"], v))
        return out

    cols = [frame, "id", "x1", "y1", "x2", "y2", "class_id"]
    return per_pair(truth.select(*cols), detections.select(*cols, "score"), frame, run, f"{frame} {kind}, truth_id long, detection_id long, iou double")


#: A cue's reach (at most, at least, in heights) to the right, below and aside, and what ranks a value below behind any beside.
REACH = {"right": (480.0, 64.0, 12.0), "below": (96.0, 32.0, 3.0), "aside": (float("inf"), 120.0, 5.0)}
ROW, BACK, BELOW = 0.45, 0.35, 10_000.0


def _tall(b: Column) -> Column:
    return F.greatest(F.lit(1.0), b["y2"] - b["y1"])


def reach(cue: Column) -> dict[str, Column]:
    """How far a cue looks, by its height."""
    return {k: F.least(F.lit(most), F.greatest(F.lit(least), times * _tall(cue))) for k, (most, least, times) in REACH.items()}


def association_rank(cue: Column, value: Column) -> Column:
    """How near a value stands to its cue: on the same row to the right, else below; null out of reach."""
    far, back = reach(cue), -BACK * _tall(cue)
    span = lambda a, b: F.least(cue[b], value[b]) - F.greatest(cue[a], value[a])
    right, down, shift = value["x1"] - cue["x2"], value["y1"] - cue["y2"], F.abs(value["x1"] - cue["x1"])
    in_row = (F.greatest(F.lit(0.0), span("y1", "y2")) >= ROW * F.least(_tall(cue), _tall(value))) & (right >= back)
    middles = F.abs(cue["y1"] + cue["y2"] - value["y1"] - value["y2"])
    beside = F.when(right <= far["right"], F.greatest(F.lit(0.0), right) + middles)
    under = F.when(down.between(back, far["below"]) & ((span("x1", "x2") > 0) | (shift <= far["aside"])), BELOW + 4 * F.greatest(F.lit(0.0), down) + shift)
    return F.when(in_row, beside).otherwise(under)


def associate(cues: DataFrame, values: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Each cue's value, one to one, in order of cue ids: the unused one in reach of the least rank, then id.

    A column ``label`` of the cues and ``fits`` of the values (an array of the
    labels that a value's text is plausible for) restrict the pairs; without them all fit.
    Candidates are found by the grid, with each cue's reach as its box; only they are
    gone through in order.
    """
    kind = cues.schema[frame].dataType.simpleString()
    typed = "label" in cues.columns and "fits" in values.columns
    xy = ("x1", "y1", "x2", "y2")
    own = F.struct(*[F.col(c).cast("double").alias(c) for c in xy])
    far, back = reach(own), BACK * _tall(own)
    around = [
        F.least(own["x1"] - far["aside"], own["x2"] - back).alias("x1"),
        F.least(own["y1"], own["y2"] - back).alias("y1"),
        F.greatest(own["x2"] + far["right"], own["x1"] + far["aside"]).alias("x2"),
        (own["y2"] + far["below"]).alias("y2"),
    ]
    c = cues.select(frame, "id", own.alias("own"), *(["label"] if typed else []), *around)
    v = values.select(frame, "id", *[F.col(x).cast("double").alias(x) for x in xy], *(["fits"] if typed else []))
    met = grid.pairs(c, v, frame, touch=True)
    if typed:
        met = met.where(F.array_contains("r.fits", F.col("l.label")))
    near = met.select(F.col(f"l.{frame}").alias(frame), F.col("l.id").alias("cue_id"), F.col("r.id").alias("value_id"), association_rank(F.col("l.own"), F.col("r")).alias("rank")).where(F.col("rank").isNotNull())

    def run(f: object, rows: list[dict]) -> list[tuple]:
        out, used = {}, set()
        for r in sorted(rows, key=lambda r: (r["cue_id"], r["rank"], r["value_id"])):
            if r["cue_id"] not in out and r["value_id"] not in used:
                used.add(r["value_id"])
                out[r["cue_id"]] = (f, r["cue_id"], r["value_id"], r["rank"])
        return list(out.values())

    return per_group(near, frame, run, f"{frame} {kind}, cue_id long, value_id long, rank double")


def valid_region(text: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a region has a text and a finite box of some size."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf"))
    return F.coalesce(F.trim(text) != "", F.lit(False)) & fine(x1) & fine(y1) & fine(x2) & fine(y2) & (x2 > x1) & (y2 > y1)


def associate_regions(regions: DataFrame, labels: list[str], frame: str = "frame_id") -> DataFrame:
    """Values of form labels by place: valid regions (id, text, box) whose text is a cue of one of ``labels`` get the nearest plausible region that is no cue."""
    from spanveil.functions import cues as words

    r = regions.where(valid_region(F.col("text"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).withColumn("label", words.field_cue(F.col("text")))
    fits = F.filter(F.array(*[F.when(words.plausible(F.lit(k), F.col("text")), F.lit(k)) for k in labels]), lambda x: x.isNotNull())
    return associate(r.where(F.col("label").isin(*labels)), r.where(F.col("label").isNull()).withColumn("fits", fits), frame)


def valued(matches: DataFrame, regions: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Matches of ``associate_regions`` as regions: the value's box, the cue's label, and a score of the value's ``ocr_confidence`` between 0.5 and 0.96."""
    from spanveil.functions import cues as words

    r = regions.select(F.col(frame).alias("_f"), F.col("id").alias("_i"), words.field_cue(F.col("text")).alias("label"), "x1", "y1", "x2", "y2", "ocr_confidence")
    cue = r.select("_f", F.col("_i").alias("cue_id"), "label")
    value = r.drop("label").withColumnRenamed("_i", "value_id")
    score = F.least(F.lit(0.96), F.greatest(F.lit(0.5), rules.finite(F.col("ocr_confidence"), 0.5)))
    both = matches.join(cue, (F.col(frame) == F.col("_f")) & (matches["cue_id"] == cue["cue_id"])).drop("_f").drop(cue["cue_id"])
    return both.join(value, (F.col(frame) == F.col("_f")) & (both["value_id"] == value["value_id"])).select(frame, "cue_id", both["value_id"], "label", "x1", "y1", "x2", "y2", score.alias("score"))


def contextual_regions(regions: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Names in greetings, delivery lines and order lines as regions, and the address that stands on and under a delivery line: frame, id, label, box, score."""
    from spanveil.functions import cues as words

    xy = ("x1", "y1", "x2", "y2")
    r = regions.where(valid_region(F.col("text"), *[F.col(c) for c in xy])).withColumn("text", F.trim("text")).withColumn("found", words.contextual_name(F.col("text"))).where(F.col("found").isNotNull())
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in xy])
    start = F.position(F.col("found.name"), F.col("text")) - 1
    grown = lambda left, up, right, down: F.struct((box["x1"] - left).alias("x1"), (box["y1"] - up).alias("y1"), (box["x2"] + right).alias("x2"), (box["y2"] + down).alias("y2"))
    two = F.lit(2.0)
    name = F.when(F.col("found.how") == "greeting", grown(two, two, two, two)).otherwise(words.text_range_box(box, F.col("text"), start, F.length("found.name")))
    place = F.when(F.col("found.how") == "delivery", grown(F.lit(0.0), F.lit(0.0), (box["x2"] - box["x1"]) * 0.25, box["y2"] - box["y1"]))
    score = F.least(F.lit(0.96), F.greatest(F.lit(0.5), rules.finite(F.col("ocr_confidence"), 0.5)))
    each = F.filter(F.array(F.struct(F.lit("NAME").alias("label"), name.alias("box")), F.struct(F.lit("ADDRESS").alias("label"), place.alias("box"))), lambda x: x["box"].isNotNull())
    return r.select(frame, "id", F.explode(each).alias("e"), score.alias("score")).select(frame, "id", "e.label", "e.box.*", "score")


def same_box(regions: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Regions of equal coordinates as one, with all labels and the best score."""
    return regions.groupBy(frame, "x1", "y1", "x2", "y2").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max("score").alias("score"), F.count("*").alias("n"))


def outside_rois(findings: DataFrame, rois: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Findings whose centre lies in no region of interest of their frame."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rows = findings.withColumn("_at", F.struct(F.col(frame), x.alias("x"), y.alias("y")))
    points = rows.select("_at").distinct().select(F.col(f"_at.{frame}").alias(frame), *[F.col(f"_at.{a}").alias(b) for a, b in (("x", "x1"), ("y", "y1"), ("x", "x2"), ("y", "y2"))])
    inside = grid.pairs(points, rois.select(frame, "x1", "y1", "x2", "y2"), frame, touch=True).select(F.struct(F.col(f"l.{frame}"), F.col("l.x1").alias("x"), F.col("l.y1").alias("y")).alias("_in")).distinct()
    return rows.join(inside, F.col("_at") == F.col("_in"), "left_anti").drop("_at")


def padded_rois(regions: DataFrame, frame: str = "frame_id", pad: float = 8.0) -> DataFrame:
    """Padded boxes, each merged into the first kept one that it meets."""
    kind = regions.schema[frame].dataType.simpleString()

    def run(f: object, rows: list[dict]) -> list[tuple]:
        out: list[list[float]] = []
        for r in sorted(rows, key=lambda r: r["id"]):
            b = [max(0.0, r["x1"] - pad), max(0.0, r["y1"] - pad), r["x2"] + pad, r["y2"] + pad]
            for k in out:
                if b[0] < k[2] and b[2] > k[0] and b[1] < k[3] and b[3] > k[1]:
                    k[:] = [min(k[0], b[0]), min(k[1], b[1]), max(k[2], b[2]), max(k[3], b[3])]
                    break
            else:
                out.append(b)
        return [(f, i, *b) for i, b in enumerate(out)]

    return per_group(regions.select(frame, "id", "x1", "y1", "x2", "y2"), frame, run, f"{frame} {kind}, id long, x1 double, y1 double, x2 double, y2 double")


def decoded(cells: DataFrame, size: int = 640, pad_share: float = 0.04, pad_least: float = 2.0) -> DataFrame:
    """Detector cells (cx, cy, w, h, scores, and the image's width and height) as boxes of the image: best class, letterbox undone, padded, clamped, sides of two at least."""
    lb = geo.letterbox(F.col("width"), F.col("height"), size)
    best = F.array_max("scores")
    w, h = F.col("w") / F.col("lb.scale"), F.col("h") / F.col("lb.scale")
    cx, cy = (F.col("cx") - F.col("lb.pad_x")) / F.col("lb.scale"), (F.col("cy") - F.col("lb.pad_y")) / F.col("lb.scale")
    px, py = F.greatest(w * pad_share, F.lit(pad_least)), F.greatest(h * pad_share, F.lit(pad_least))
    box = F.struct((cx - w / 2 - px).alias("x1"), (cy - h / 2 - py).alias("y1"), (cx + w / 2 + px).alias("x2"), (cy + h / 2 + py).alias("y2"))
    out = cells.withColumn("lb", lb).withColumn("class_id", (F.array_position("scores", best) - 1).cast("int")).withColumn("score", best).withColumn("b", geo.clamp(box, F.col("width"), F.col("height")))
    return out.where((F.col("b.x2") - F.col("b.x1") >= 2) & (F.col("b.y2") - F.col("b.y1") >= 2)).drop("lb", "cx", "cy", "w", "h", "scores")


def compatible(truth_class: Column, source_class: Column, labels: Column) -> Column:
    """Whether a region's labels may stand for a true class."""
    # Which labels count for which classes.
    by_class = {"NAME": ["GIVEN_NAME", "SURNAME"], "ADDRESS": ["BUILDING_NUMBER", "STREET_NAME", "SECONDARY_ADDRESS"], "CARD_NUMBER": ["CREDIT_CARD"], "CVC": ["CVC"], "SECRET": ["SECRET"]}
    by_source = {
        ("SENSITIVE_FIELD", "DOB"): ["DOB"],
        ("SENSITIVE_FIELD", "GOV_ID"): ["GOVERNMENT_ID", "SSN", "TAX_ID", "PASSPORT", "DRIVERS_LICENSE"],
        ("SENSITIVE_FIELD", "BANK_ACCOUNT"): ["BANK_ACCOUNT", "ROUTING_NUMBER"],
        ("SECRET", "PASSWORD"): ["PASSWORD"],
        ("SECRET", "API_KEY"): ["API_KEY"],
        ("SECRET", "AUTH_TOKEN"): ["AUTH_TOKEN"],
        ("SECRET", "PRIVATE_KEY"): ["PRIVATE_KEY"],
    }
    any_of = lambda names: F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))
    ok = F.array_contains(labels, truth_class) | F.array_contains(labels, source_class)
    for c, names in by_class.items():
        ok = ok | ((truth_class == c) & any_of(names))
    for (c, s), names in by_source.items():
        ok = ok | ((truth_class == c) & (source_class == s) & any_of(names))
    return F.coalesce(ok, F.lit(False))
