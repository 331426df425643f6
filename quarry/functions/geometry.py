"""Boxes and crops as Column expressions; coordinates are cut towards zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.numeric import half_up


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))))


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def main_face(faces: Column) -> Column:
    """Of ``array<struct<x1,y1,x2,y2>>``: the first of greatest area; null for none."""
    greatest = F.array_max(F.transform(faces, area))
    return F.try_element_at(F.filter(faces, lambda b: area(b) == greatest), F.lit(1))


def face_size_px(box: Column) -> Column:
    return area(box).cast("long")


def face_proportion(box: Column, w: Column, h: Column, rounded: bool = True) -> Column:
    share = area(box).cast("double") / (w.cast("double") * h.cast("double")) * 100
    return half_up(share, 1) if rounded else share


def expression_crop(box: Column, w: Column, h: Column, margin: float = 0.15) -> Column:
    """The face with a margin of its own size, within the image."""
    mx, my = (box["x2"] - box["x1"]) * margin, (box["y2"] - box["y1"]) * margin
    return _box(F.greatest(F.lit(0.0), box["x1"] - mx), F.greatest(F.lit(0.0), box["y1"] - my), F.least(w.cast("double"), box["x2"] + mx), F.least(h.cast("double"), box["y2"] + my))


def body_crop(box: Column, w: Column, h: Column) -> Column:
    """What lies below the chin, if more than 50 pixels remain; else the whole image."""
    whole = _box(F.lit(0), F.lit(0), w, h)
    return F.when(box.isNotNull() & (h - box["y2"].cast("int") > 50), _box(F.lit(0), box["y2"], w, h)).otherwise(whole)


def square_crop(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, margin: float = 0.6) -> Column:
    """A square about the face, grown by the margin on both sides, no larger than the image, moved inside it."""
    width, height = w.cast("double"), h.cast("double")
    half = F.least(F.greatest(x2 - x1, y2 - y1) * F.lit(1 + 2 * margin), F.least(width, height)) / F.lit(2.0)
    cx = F.greatest(half, F.least(width - half, (x1 + x2) / F.lit(2.0)))
    cy = F.greatest(half, F.least(height - half, (y1 + y2) / F.lit(2.0)))
    return _box(cx - half, cy - half, cx + half, cy + half)


def nearest_bucket(w: Column, h: Column, resolutions: Column) -> Column:
    """The first of the resolutions ``array<struct<w,h>>`` whose ratio is nearest the image's."""
    ratio = w.cast("double") / h.cast("double")
    ranked = F.transform(resolutions, lambda r, i: F.struct(F.abs(r["w"].cast("double") / r["h"].cast("double") - ratio).alias("gap"), i.alias("i"), r["w"].alias("w"), r["h"].alias("h")))
    best = F.array_min(ranked)
    return F.struct(best["w"].alias("w"), best["h"].alias("h"))


def bucket_crop(box: Column, w: Column, h: Column, bucket: Column, margin: float = 0.7) -> Column:
    """A crop of the bucket's ratio about the face; without face about the centre."""
    width, height = w.cast("double"), h.cast("double")
    ratio = bucket["w"].cast("double") / bucket["h"].cast("double")
    two = F.lit(2.0)
    mid_x = F.when(box.isNotNull(), (box["x1"] + box["x2"]) / two).otherwise(width / two)
    mid_y = F.when(box.isNotNull(), (box["y1"] + box["y2"]) / two).otherwise(height / two)
    side = F.when(box.isNotNull(), F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"])).otherwise(F.least(width, height) / F.lit(4.0)) * F.lit(1 + 2 * margin)
    # the wanted crop holds the side in both directions; then it is cut to the image and to the ratio
    want_w = F.when(ratio >= 1, F.greatest(side, side * ratio)).otherwise(F.greatest(side, side / ratio) * ratio)
    want_h = F.when(ratio >= 1, want_w / ratio).otherwise(F.greatest(side, side / ratio))
    cut_w, cut_h = F.least(want_w, width), F.least(want_h, height)
    wide = cut_w / cut_h > ratio
    half_w = F.when(wide, cut_h * ratio).otherwise(cut_w) / two
    half_h = F.when(wide, cut_h).otherwise(cut_w / ratio) / two
    cx, cy = F.greatest(half_w, F.least(width - half_w, mid_x)), F.greatest(half_h, F.least(height - half_h, mid_y))
    return _box(cx - half_w, cy - half_h, cx + half_w, cy + half_h)


def centre_crop(w: Column, h: Column, target_w: Column, target_h: Column) -> Column:
    """The largest centred crop of the target's ratio."""
    ratio = target_w.cast("double") / target_h.cast("double")
    wide = w.cast("double") / h.cast("double") > ratio
    new_w = F.when(wide, (h * ratio).cast("int")).otherwise(w)
    new_h = F.when(wide, h).otherwise((w / ratio).cast("int"))
    left, top = F.floor((w - new_w) / 2), F.floor((h - new_h) / 2)
    return _box(left, top, left + new_w, top + new_h)
