"""Polygons, matching, overlap removal and packing against sequential versions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pagewright.functions import polygons
from pagewright.operators import grid, matching, overlaps, packing

POINTS = "array<struct<x: double, y: double>>"


def clipped_area(p, q):
    """Shared area of a polygon and a convex one, by exact cuts; signed parts of a polygon that is not convex add up."""
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    size = lambda s: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(s, s[1:] + s[:1])) / 2
    p, q = ([(Fraction(x), Fraction(y)) for x, y in s] for s in (p, q))
    q = q if size(q) > 0 else q[::-1]
    for a, b in zip(q, q[1:] + q[:1]):
        out = []
        for last, now in zip(p[-1:] + p[:-1], p):
            d, e = turn(a, b, last), turn(a, b, now)
            if (d >= 0) != (e >= 0):
                t = d / (d - e)
                out.append((last[0] + (now[0] - last[0]) * t, last[1] + (now[1] - last[1]) * t))
            if e >= 0:
                out.append(now)
        p = out
    return float(abs(size(p))) if len(p) > 2 else 0.0


def hull(points):
    points = sorted(set(points))
    half = lambda ps: [q for q in _half(ps)][:-1]
    return half(points) + half(points[::-1])


def _half(points):
    out = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


def test_intersections(spark):
    r = random.Random(1)
    shape = lambda n: hull([(r.randrange(20), r.randrange(20)) for _ in range(n)])
    star = [(0, 0), (20, 0), (20, 20), (10, 5), (0, 20)]  # not convex
    pairs = [(shape(7), shape(5)) for _ in range(60)] + [(star, shape(6)) for _ in range(30)] + [(star[::-1], shape(6)[::-1]) for _ in range(5)]
    pairs += [([(0, 0), (4, 0), (4, 4), (0, 4)], s) for s in ([(4, 0), (8, 0), (8, 4), (4, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)], [(9, 9), (10, 9), (9, 10)])]
    pairs = [(p, q) for p, q in pairs if len(p) > 2 and len(q) > 2]
    real = lambda s: [(float(x), float(y)) for x, y in s]
    df = spark.createDataFrame([(i, real(p), real(q)) for i, (p, q) in enumerate(pairs)], f"n long, p {POINTS}, q {POINTS}")
    got = {r.n: r.v for r in df.select("n", polygons.intersection_area(F.col("p"), F.col("q")).alias("v")).collect()}
    assert all(abs(got[i] - clipped_area(p, q)) < 1e-9 for i, (p, q) in enumerate(pairs))
    few = spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0)], real(star)), (None, real(star)), ([], real(star))], f"p {POINTS}, q {POINTS}")
    assert [r.v for r in few.select(polygons.intersection_area(F.col("p"), F.col("q")).alias("v")).collect()] == [None] * 3


def made(seed, n, pages=3, spread=300):
    r = random.Random(seed)
    return [(r.choice([None, *range(pages)]), i, float(r.randrange(spread)), float(r.randrange(spread)), float(r.choice([1, 5, 20, 30, 200])), float(r.choice([1, 6, 10, 90]))) for i in range(n)]


def shared(a, b):
    return max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))


def folded(rows, overlap=0.65):
    """The sequential rule."""
    kept = []
    for b in sorted(rows, key=lambda b: (-b[4] * b[5], b[1], *b[2:])):
        if not any(k[0] == b[0] and min(k[4] * k[5], b[4] * b[5]) > 1.2e-7 and shared(k, b) / min(k[4] * k[5], b[4] * b[5]) >= overlap for k in kept):
            kept.append(b)
    return sorted((k[0] is not None, k[0] or 0, k[1]) for k in kept)


def survivors(spark, rows, overlap=0.65):
    df = spark.createDataFrame(rows, "image_id long, position long, x double, y double, width double, height double").withColumn("rank", F.lit("clash"))
    return sorted((r.image_id is not None, r.image_id or 0, r.position) for r in overlaps.drop_overlaps(df, overlap=overlap).collect())


@pytest.mark.parametrize("dense", [200, 0])
def test_overlap_removal_equals_the_fold(spark, monkeypatch, dense):
    """By pairs alone, and with every box settled on top of its cells."""
    monkeypatch.setattr(overlaps, "DENSE", dense)
    rows = made(1, 250 if dense else 60, spread=150) + [(0, 900 + i, 5.0, 5.0, 20.0, 10.0) for i in range(20)]
    rows += [(1, 990, 3.0, 3.0, 0.0, 9.0), (1, 991, 3.0, 3.0, -5.0, -9.0)]
    assert survivors(spark, rows) == folded(rows)


def test_odd_boxes_stay(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, 0.0, 0.0, 50.0, 50.0), (0, 1, nan, 1.0, 5.0, 5.0), (0, 2, 1.0, 1.0, inf, 5.0), (0, 3, None, 1.0, 5.0, 5.0), (0, 4, 1.0, 1.0, 5.0, 5.0), (0, 4, 1.0, 1.0, 5.0, 5.0)]
    assert [p for *_, p in survivors(spark, rows)] == [0, 1, 2, 3] and survivors(spark, []) == []
    with pytest.raises(ValueError):
        overlaps.drop_overlaps(spark.createDataFrame(rows, "image_id long, position long, x double, y double, width double, height double"), overlap=0)


def test_a_page_of_many_boxes(spark):
    """A hundred thousand boxes of one page, most of them in stacks of near copies."""
    n = spark.range(100_000).select(
        F.lit(None).cast("long").alias("image_id"), F.col("id").alias("position"), (F.col("id") % 250 * 40 + F.col("id") % 3).cast("double").alias("x"),
        (F.floor(F.col("id") / 250) % 100 * 20).cast("double").alias("y"), F.lit(36.0).alias("width"), (F.lit(16.0) + F.col("id") % 2).alias("height"),
    )
    rows = [tuple(r) for r in n.filter("position % 250 < 4 and floor(position / 250) % 100 < 3").collect()]
    got = overlaps.drop_overlaps(n)
    assert got.count() == 25_000
    want = {p for *_, p in folded(rows)}
    assert {r.position for r in got.filter("position % 250 < 4 and floor(position / 250) % 100 < 3").collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def sequential(refs, preds, iou):
    used, out = set(), []
    for p in sorted({r[0] for r in refs}, key=repr):
        for r in sorted((r for r in refs if r[0] == p), key=lambda r: r[1]):
            free = [(iou(r, q), -q[1]) for q in preds if q[0] == p and (p, q[1]) not in used]
            best = max(free, default=(0, 0))
            if best[0] >= 0.5:
                used.add((p, -best[1]))
                out.append((repr(p), r[1], -best[1]))
    return sorted(out)


def test_matching_equals_the_sequential_rule(spark):
    refs = made(3, 90, 2, 60)
    preds = [(p, i, x + i % 3, y, w, h) for p, i, x, y, w, h in refs] + [(0, 500 + i, 10.0 + i % 2, 10.0, 20.0, 10.0) for i in range(12)]
    refs += [(0, 600 + i, 10.0, 10.0 + i % 2, 20.0, 10.0) for i in range(12)] + [(0, 700, float("nan"), 1.0, 2.0, 3.0)]
    schema = "image_id long, idx long, x double, y double, width double, height double"
    got = matching.greedy_matches(spark.createDataFrame(refs, schema), spark.createDataFrame(preds, schema))
    area = lambda b: b[4] * b[5]
    assert sorted((repr(r.image_id), r.ref_idx, r.pred_idx) for r in got.collect()) == sequential(refs, preds, lambda a, b: shared(a, b) / (area(a) + area(b) - shared(a, b)))


def test_polygons_unreadable_regions_and_texts(spark):
    turned = lambda x, y, w, h: [(a * 0.6 - b * 0.8, a * 0.8 + b * 0.6) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    refs = [
        (0, 0, turned(0, 0, 100, 10), "Straße"), (0, 1, turned(0, 40, 100, 10), "###"), (0, 2, turned(0, 80, 100, 10), '"Two"'), (0, 3, turned(0, 120, 100, 10), None),
        (None, 0, turned(0, 0, 50, 10), "a"), (1, 0, turned(0, 0, 50, 10), "missed"),
    ]
    preds = [
        (0, 0, turned(3, 0, 100, 10), "STRASSE!"), (0, 1, turned(0, 41, 60, 10), "excused"), (0, 2, turned(0, 80, 100, 10), "two."), (0, 3, turned(0, 120, 100, 10), None),
        (0, 4, turned(0, 44, 100, 10), "half of it counts"), (None, 0, turned(0, 0, 50, 10), "b"), (2, 0, [(0.0, 0.0), (1.0, 1.0)], "line"), (2, 1, None, "none"),
    ]
    tables = [spark.createDataFrame(t, f"image_id long, idx long, points {POINTS}, text string").withColumn("iou", F.lit("clash")) for t in (refs, preds)]
    got = sorted((repr(r.image_id), r.ref_idx, r.pred_idx, round(r.iou, 6), r.same_text) for r in matching.polygon_matches(*tables).collect())
    assert got == [("0", 0, 0, round(97 / 103, 6), True), ("0", 2, 2, 1.0, True), ("0", 3, 3, 1.0, False), ("None", 0, 0, 1.0, False)]
    scores = {repr(r.image_id): r for r in matching.end_to_end_scores(*tables).collect()}
    assert (scores["0"].refs, scores["0"].preds, scores["0"].hits, scores["0"].text_hits) == (3, 3, 3, 2)
    assert (scores["1"].recall, scores["1"].precision, scores["1"].h_mean) == (0.0, None, 0.0) and scores["2"].preds == 2


@pytest.mark.parametrize("far", [0, 300_000])
def test_equal_shares_of_turned_polygons_are_equal(spark, far):
    """A pair at the least overlap matches, and of predictions that lie alike the first is taken, at any angle and place."""
    turns = [(0.6, 0.8), (0.8, -0.6), (math.cos(1), math.sin(1)), (math.cos(0.1), math.sin(0.1)), (math.cos(2.5), math.sin(2.5))]

    def turned(page, x, y, w, h):
        c, s = turns[page % len(turns)]
        x, y = x + far + page * 37 % 1000, y + far + page * 91 % 600
        return [(a * c - b * s, a * s + b * c) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]

    refs, preds = [], []
    for page in range(60):
        w, h = 60 + page * 3, 10 + page % 13
        refs += [(page, 0, turned(page, 0, 0, w, h), "a"), (page, 1, turned(page, 0, 100, w, h), "b"), (page, 2, turned(page, 0, 200, w, h), "c")]
        preds += [(page, 0, turned(page, 0, 0, 2 * w, h), "a")]  # half, exactly
        preds += [(page, 1 + i, turned(page, d, 100, w, h), "b") for i, d in enumerate((5, -5, 5))]  # alike
        preds += [(page, 4, turned(page, 0, 200, 2 * w + 1, h), "c")]  # less than half
    tables = [spark.createDataFrame(t, f"image_id long, idx long, points {POINTS}, text string") for t in (refs, preds)]
    got = {(r.image_id, r.ref_idx): (r.pred_idx, r.iou) for r in matching.polygon_matches(*tables).collect()}
    side = [60 + page * 3 for page in range(60)]
    want = {(page, 0): (0, 0.5) for page in range(60)} | {(page, 1): (1, (w - 5) / (w + 5)) for page, w in enumerate(side)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [4096, 5])
def test_packing_equals_the_sequential_rule(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    r = random.Random(block)
    rows = [(r.choice([None, 1, 2]), i, r.choice([5, 60, 200, 300, 600, 900, 4000, 20000])) for i in range(90)] + [(3, 0, None)]
    df = spark.createDataFrame(rows, "image_id long, box_idx long, width long")
    got = sorted((repr(r.image_id), r.box_idx, r.batch) for r in packing.width_batches(df, 8, 8192).collect())
    want = []
    for p in {row[0] for row in rows}:
        batch = count = widest = 0
        for w, i in sorted((row[2] or 0, row[1]) for row in rows if row[0] == p):
            if count and (count + 1 > 8 or max(widest, w) * (count + 1) > 8192 or (count >= 2 and w > max(256, 1.85 * widest))):
                batch, count, widest = batch + 1, 0, 0
            count, widest = count + 1, max(widest, w)
            want.append((repr(p), i, batch))
    assert got == sorted(want)
    assert grid.levels_of(grid.with_level(df.select(F.lit(3.0).alias("width"), F.lit(9.0).alias("height")))) == [4]
