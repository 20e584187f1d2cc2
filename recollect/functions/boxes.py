"""Boxes (left, top, right, bottom) as arrays of doubles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: overlap above which a box is suppressed, least visible side of a crop, strides of the grid detector
NMS_IOU, MIN_SIDE = 0.45, 16
STRIDES = (8, 16, 32)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union with pixels counted at both ends."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo + 1)
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return inter / (area(a) + area(b) - inter)


def nms(found: DataFrame, most: float = NMS_IOU) -> DataFrame:
    """found: frame_id, id, conf, box -> the rows that stay: surest first, whatever overlaps a kept one by more goes.

    A frame's boxes, which are few, are one sorted array that is folded; nothing leaves the JVM."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), "id", "conf", "box")))
    g = found.groupBy("frame_id").agg(ordered.alias("b"))
    none = F.slice("b", 1, 0)
    kept = F.aggregate("b", none, lambda s, x: F.when(F.exists(s, lambda k: overlap(k["box"], x["box"]) > most), s).otherwise(F.concat(s, F.array(x))))
    return g.select("frame_id", F.explode(kept).alias("x")).select("frame_id", "x.id", "x.conf", "x.box")


def merge_detectors(first: DataFrame, second: DataFrame, most: float = 0.5) -> DataFrame:
    """frame_id, label, conf, box: all of first, and those of second that first doesn't have in the same place."""
    a = first.select("frame_id", "label", F.col("box").alias("other"))
    new = second.join(a, (second.frame_id == a.frame_id) & (second.label == a.label) & (overlap(second.box, a.other) > most), "left_anti")
    return first.unionByName(new)


def crop_square(box: Column, width: Column, height: Column) -> Column:
    """struct<x, y, side> as wide as the longer side, moved to stay inside; null if the visible part is under MIN_SIDE."""
    half_up = lambda c: F.floor(c + 0.5)
    l, t = F.greatest(F.lit(0.0), box[0]), F.greatest(F.lit(0.0), box[1])
    r, b = F.least(width.cast("double"), box[2]), F.least(height.cast("double"), box[3])
    side = F.least(half_up(F.greatest(r - l, b - t)), F.least(width, height).cast("long"))
    x = F.least(F.greatest(half_up((l + r) / 2 - side / 2), F.lit(0).cast("long")), width - side)
    y = F.least(F.greatest(half_up((t + b) / 2 - side / 2), F.lit(0).cast("long")), height - side)
    return F.when((r - l >= MIN_SIDE) & (b - t >= MIN_SIDE), F.struct(x.alias("x"), y.alias("y"), side.alias("side")))


def things(objects: Column, least: float = 0.35) -> Column:
    """array<struct<label, conf, ..>> without unsure ones and without people, who are counted apart."""
    return F.filter(objects, lambda o: (o["conf"] >= least) & (o["label"] != "person"))


def people(objects: Column, least: float = 0.35) -> Column:
    return F.size(F.filter(objects, lambda o: (o["conf"] >= least) & (o["label"] == "person")))


def decode_grid(rows: np.ndarray, width: int, height: int, ratio: float, least: float) -> list[tuple]:
    """Boxes of a grid detector with strides 8, 16, 32: rows of (x, y, w, h, objectness, classes..) -> (class, conf, box)."""
    xs, ys, steps = [], [], []
    for step in STRIDES:
        gy, gx = np.mgrid[0 : height // step, 0 : width // step]
        xs.append(gx.ravel())
        ys.append(gy.ravel())
        steps.append(np.full(gx.size, step))
    x, y, s = (np.concatenate(v) for v in (xs, ys, steps))
    cx, cy = (rows[:, 0] + x) * s / ratio, (rows[:, 1] + y) * s / ratio
    w, h = np.exp(rows[:, 2]) * s / ratio, np.exp(rows[:, 3]) * s / ratio
    conf = rows[:, 4:5] * rows[:, 5:]
    best = conf.argmax(1)
    top = conf[np.arange(len(conf)), best]
    return [(int(best[i]), float(top[i]), (cx[i] - w[i] / 2, cy[i] - h[i] / 2, cx[i] + w[i] / 2, cy[i] + h[i] / 2)) for i in np.flatnonzero(top >= least)]


def decode_queries(logits: np.ndarray, boxes: np.ndarray, width: int, height: int, least: float = 0.5) -> list[tuple]:
    """Boxes of a query detector: per query the best class by sigmoid, centre and size in shares of the picture."""
    best = logits.argmax(1)
    conf = 1 / (1 + np.exp(-logits[np.arange(len(logits)), best]))
    cx, cy, w, h = boxes.T * np.array([[width], [height], [width], [height]])
    return [(int(best[i]), float(conf[i]), (cx[i] - w[i] / 2, cy[i] - h[i] / 2, cx[i] + w[i] / 2, cy[i] + h[i] / 2)) for i in np.flatnonzero(conf >= least)]


def tiles(width: int, height: int, side: int, columns: int, rows: int) -> list[tuple[int, int]]:
    """Left top corners of evenly spread square tiles."""
    return [(int(round(x)), int(round(y))) for y in np.linspace(0, height - side, rows) for x in np.linspace(0, width - side, columns)]


def decode_columns(rows: np.ndarray, scale: float, width: int, height: int, least: float) -> list[tuple]:
    """Per word (row 4 on) the best column of (cx, cy, w, h, scores..): (word, conf, box), letterbox undone, inside the picture."""
    out = []
    for word in range(4, len(rows)):
        best = int(rows[word].argmax())
        conf = float(rows[word, best])
        if conf >= least:
            cx, cy, w, h = rows[:4, best] / scale
            box = (max(0.0, cx - w / 2), max(0.0, cy - h / 2), min(float(width), cx + w / 2), min(float(height), cy + h / 2))
            out.append((word - 4, conf, tuple(map(float, box))))
    return out
