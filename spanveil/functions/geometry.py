"""Column functions on boxes, which are structs with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for empty boxes."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def coverage(region: Column, truth: Column) -> Column:
    """The share of a true box that a region covers."""
    return F.when(area(truth) > 0, intersection(region, truth) / area(truth)).otherwise(0.0)


def center_in(b: Column, roi: Column) -> Column:
    x, y = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return x.between(roi["x1"], roi["x2"]) & y.between(roi["y1"], roi["y2"])


def clamp(b: Column, width: Column, height: Column) -> Column:
    """A box inside its image."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    return F.struct(inside(b["x1"], width).alias("x1"), inside(b["y1"], height).alias("y1"), inside(b["x2"], width).alias("x2"), inside(b["y2"], height).alias("y2"))


def mask_cells(b: Column, width: Column, height: Column) -> Column:
    """The whole pixels that a box touches, inside its image."""
    low = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int")
    high = lambda v, most: F.least(most, F.ceil(v)).cast("int")
    return F.struct(low(b["x1"]).alias("x1"), low(b["y1"]).alias("y1"), high(b["x2"], width).alias("x2"), high(b["y2"], height).alias("y2"))


def letterbox(width: Column, height: Column, side: int = 640) -> Column:
    """Scale, scaled size and padding that fit an image into a square; halves round to even."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), F.floor((side - w) / 2).cast("int").alias("pad_x"), F.floor((side - h) / 2).cast("int").alias("pad_y"))


def detector_side(x: Column) -> Column:
    """A side rounded to a multiple of 32, at least one."""
    return F.greatest(F.lit(32), (F.bround(x / 32) * 32).cast("int"))


def yolo_line(class_id: Column, b: Column, width: Column, height: Column) -> Column:
    """A label line: class, centre and size as shares of the image."""
    return F.format_string(
        "%d %.8f %.8f %.8f %.8f",
        class_id,
        (b["x1"] + b["x2"]) / 2 / width,
        (b["y1"] + b["y2"]) / 2 / height,
        (b["x2"] - b["x1"]) / width,
        (b["y2"] - b["y1"]) / height,
    )


def quad_bounds(points: Column) -> Column:
    """The box around an array of (x, y) pairs."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
