"""Columns over points, quads and boxes.

A quad is array<struct<x,y>> with four points (top left, top right, bottom right, bottom left); a box is a struct of
x, y, width, height. Arithmetic is in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad_from_rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.array(point(x, y), point(x + width, y), point(x + width, y + height), point(x, y + height))


def bounds(points: Column) -> Column:
    """Least box around the points; null for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(
        F.array_min(xs).alias("x"),
        F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs)).alias("width"),
        (F.array_max(ys) - F.array_min(ys)).alias("height"),
    )
    return F.when(F.size(points) > 0, box)


def signed_area(points: Column) -> Column:
    """Shoelace sum of the closed polygon."""
    nexts = F.concat(F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), F.slice(points, 1, 1))
    cross = F.zip_with(points, nexts, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c) / 2


def area(points: Column) -> Column:
    return F.abs(signed_area(points))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def overlap_over_smaller(a: Column, b: Column) -> Column:
    """Shared area of two boxes as a share of the smaller one; 0 if that has no area."""
    dx = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    dy = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
    shared = F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0))
    return F.when(smaller <= EPSILON, F.lit(0.0)).otherwise(shared / smaller)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), value))


def quad_from_points(points: Column, width: Column, height: Column) -> Column:
    """The first four points within the image; of fewer, their box if it has an area; null for none."""
    inside = F.transform(F.slice(points, 1, 4), lambda p: point(clamp(p["x"], 0.0, width), clamp(p["y"], 0.0, height)))
    box = bounds(inside)
    rect = quad_from_rect(box["x"], box["y"], box["width"], box["height"])
    return F.when(F.size(points) >= 4, inside).when((F.size(points) > 0) & (box["width"] > 0) & (box["height"] > 0), rect)


def interpolate(a: Column, b: Column, at: Column) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * at, a["y"] + (b["y"] - a["y"]) * at)


def slice_quad(quad: Column, left: Column, right: Column) -> Column:
    """The part of a line's quad between two shares of its width."""
    tl, tr, br, bl = (F.get(quad, F.lit(i)) for i in range(4))
    return F.array(interpolate(tl, tr, left), interpolate(tl, tr, right), interpolate(bl, br, right), interpolate(bl, br, left))


def translate(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def unclip_delta(width: Column, height: Column, ratio: Column) -> Column:
    """How far each edge of a rotated rectangle moves out."""
    around = 2 * (width + height)
    return F.when(around <= 0, F.lit(0.0)).otherwise(width * height * ratio / around)


def normalize_angle(angle: Column) -> Column:
    """To (-pi/2, pi/2]."""
    turned = F.pmod(angle, F.lit(math.pi))
    return F.when(turned > math.pi / 2, turned - math.pi).otherwise(turned)


def point_in_quad(x: Column, y: Column, quad: Column) -> Column:
    """Whether a point lies in a convex quad, edges included up to a small tolerance."""
    nexts = F.concat(F.slice(quad, 2, 3), F.slice(quad, 1, 1))
    sides = F.zip_with(quad, nexts, lambda p, q: (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))
    return F.forall(sides, lambda c: c >= -1e-6) | F.forall(sides, lambda c: c <= 1e-6)


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("double")


def scale_quad(quad: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """To pixels of the source image, rounded and clamped."""
    return F.transform(
        quad,
        lambda p: point(clamp(round_half_up(p["x"] * sx), 0.0, width), clamp(round_half_up(p["y"] * sy), 0.0, height)),
    )


def crop_geometry(quad: Column) -> Column:
    """width and height (means of opposite sides), centre and angle of a quad."""
    tl, tr, br, bl = (F.get(quad, F.lit(i)) for i in range(4))
    centre = lambda c: (tl[c] + tr[c] + br[c] + bl[c]) / 4
    return F.struct(
        ((distance(tl, tr) + distance(bl, br)) / 2).alias("width"),
        ((distance(tl, bl) + distance(tr, br)) / 2).alias("height"),
        centre("x").alias("cx"),
        centre("y").alias("cy"),
        normalize_angle(F.atan2(tr["y"] - tl["y"], tr["x"] - tl["x"])).alias("angle"),
    )


def detection_size(width: Column, height: Column, max_side: Column) -> Column:
    """Input size of the detector: never enlarged, sides multiples of 32 and at least 32."""
    scale = F.least(F.lit(1.0), max_side / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(32), (round_half_up(v * scale / 32) * 32).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def recognition_width(width: Column, height: Column) -> Column:
    """Width of a crop at 48 pixels height, 1 to 3200."""
    return clamp(F.ceil(width * 48 / height).cast("int"), F.lit(1), F.lit(3200))


def padded_width(width: Column) -> Column:
    """Of a batch: a multiple of 8 of at least 320."""
    return F.greatest(F.lit(320), (F.ceil(width / 8) * 8).cast("int"))
