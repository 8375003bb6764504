"""Raster kernels on arrays: regions of heatmaps, of a stack of images at a time; input tensors and crops, image by image."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PIXELS, MIN_SIDE, MIN_UNCLIPPED, MIN_SCALED, MAX_REGIONS = 4, 3.0, 5.0, 4.0, 1000
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Heatmaps are stacked, and boxes scored together, up to about as many pixels; it decides memory only.
PIXELS_AT_ONCE = 1 << 19


def _spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the spans of these lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line (over all images), first column, end and label 0.. of the runs of set pixels of a stack of boolean images.

    Runs of one 8-connected part have one label; labels go by images and first pixels in row-major order. Runs hook onto the
    least label next to them and then jump along labels, until neighbours agree.
    """
    n, h, w = masks.shape
    sides = np.zeros((n * h, w + 2), np.int8)
    sides[:, 1:-1] = masks.reshape(n * h, w)
    turns = (sides[:, 1:] - sides[:, :-1]).reshape(-1)
    line, first = np.divmod(np.flatnonzero(turns == 1), w + 1)
    end = np.flatnonzero(turns == -1) % (w + 1)
    key = line * (w + 2)
    low = np.searchsorted(key + end, key - (w + 2) + first)
    met = np.where(line % h > 0, np.searchsorted(key + first, key - (w + 2) + end, "right") - low, 0)
    a, b = np.repeat(np.arange(len(line)), met), np.repeat(low, met) + _spans(met)
    label = np.arange(len(line))
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(label, a, b)
        while (label != (jump := label[label])).any():
            label = jump
    return line, first, end, np.searchsorted(np.flatnonzero(label == np.arange(len(line))), label)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1.. of the 8-connected parts of a boolean image, in row-major order of their first pixels; 0 outside."""
    h, w = mask.shape
    line, first, end, label = _runs(mask[None])
    steps = np.zeros((h, w + 1), np.int32)
    steps[line, first] += (label + 1).astype(np.int32)
    np.subtract.at(steps, (line, end), label + 1)
    return np.cumsum(steps, axis=1, dtype=np.int32)[:, :w]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners in turning order, without those on a straight edge."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _convex_hulls(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, x and y of the corners of the hull of each group of points, as of convex_hull (two of points on a line).

    A point on or beside the line between its neighbours of a half is no corner, so all of these leave at once. What is
    still shrinking after a few rounds goes through convex_hull.
    """
    order = np.lexsort((y, x, group))
    group, x, y = group[order], x[order], y[order]
    new = np.append(True, (group[1:] != group[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(group)]  # equal points would drop each other
    order = np.flatnonzero(new)
    half = np.concatenate([2 * group[order], 2 * group[order[::-1]] + 1])
    order = np.concatenate([order, order[::-1]])[np.argsort(half, kind="stable")]
    half = np.sort(half, kind="stable")
    x, y = x[order].astype(float), y[order].astype(float)
    for _ in range(16):
        cross = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (y[1:-1] - y[:-2]) * (x[2:] - x[:-2])
        drop = (half[1:-1] == half[:-2]) & (half[1:-1] == half[2:]) & (cross <= 0)
        slow = np.unique(half[1:-1][drop] // 2)
        if not len(slow):
            break
        keep = np.concatenate([[True], ~drop, [True]])
        half, x, y = half[keep], x[keep], y[keep]
    rest = [convex_hull(np.stack([x[s], y[s]], axis=1)) for s in (half // 2 == g for g in slow)]
    ends = np.append(half[1:] != half[:-1], True)[: len(half)]  # with the last point of a half the other one begins
    keep = ~ends & ~np.isin(half // 2, slow)
    group = np.concatenate([half[keep] // 2, np.repeat(slow, [len(r) for r in rest])])
    x, y = (np.concatenate([v[keep], *[r[:, i] for r in rest]]) for i, v in enumerate((x, y)))
    order = np.argsort(group, kind="stable")
    return group[order], x[order], y[order]


def min_area_rects(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Centre x, y, width, height, angle of the smallest rectangle along an edge of each hull; width >= height.

    The corners of the hulls follow each other, `counts` of each.
    """
    if not len(counts):
        return (np.zeros(0),) * 5
    start = np.cumsum(counts) - counts
    after = np.arange(len(x)) + 1
    after[start + counts - 1] = start
    angles = np.arctan2(y[after] - y, x[after] - x)
    ux, uy = np.cos(angles), np.sin(angles)
    per_edge = np.repeat(counts, counts)
    edge = np.repeat(np.arange(len(x)), per_edge)
    point = np.repeat(np.repeat(start, counts), per_edge) + _spans(per_edge)
    along = ux[edge] * x[point] + uy[edge] * y[point]
    across = -uy[edge] * x[point] + ux[edge] * y[point]
    at = np.cumsum(per_edge) - per_edge
    (a0, a1), (b0, b1) = ((np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)) for v in (along, across))
    wide, high = a1 - a0, b1 - b0
    size = wide * high
    least = size == np.repeat(np.minimum.reduceat(size, start), counts)
    k = np.minimum.reduceat(np.where(least, np.arange(len(x)), len(x)), start)
    a, b = (a0[k] + a1[k]) / 2, (b0[k] + b1[k]) / 2
    turned = high[k] > wide[k]
    angle = np.array([math.remainder(v, math.pi) for v in np.where(turned, angles[k] + math.pi / 2, angles[k])])
    return (
        a * ux[k] - b * uy[k], a * uy[k] + b * ux[k], np.where(turned, high[k], wide[k]), np.where(turned, wide[k], high[k]),
        np.where(angle <= -math.pi / 2, math.pi / 2, angle),
    )


def min_area_rect(hull: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre x, y, width, height, angle of the smallest rectangle along an edge of the hull; width >= height."""
    return tuple(float(v[0]) for v in min_area_rects(hull[:, 0], hull[:, 1], np.array([len(hull)])))


def rect_quads(cx: np.ndarray, cy: np.ndarray, width: np.ndarray, height: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Corners of each rectangle: an array of rectangles, four corners, x and y."""
    c, s = (np.array([f(a) for a in angle])[:, None] for f in (math.cos, math.sin))
    x, y = (np.outer(v, sign) / 2 for v, sign in ((width, (-1, 1, 1, -1)), (height, (-1, -1, 1, 1))))
    return np.stack([x * c - y * s + cx[:, None], x * s + y * c + cy[:, None]], axis=2)


def rect_quad(cx: float, cy: float, width: float, height: float, angle: float) -> np.ndarray:
    return rect_quads(*(np.array([v], float) for v in (cx, cy, width, height, angle)))[0]


def box_scores(heats: np.ndarray, image: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Mean of the pixels of its image whose centres lie in each quad; 0 if there are none."""
    _, h, w = heats.shape
    out = np.zeros(len(quads))
    low = np.maximum(np.floor(quads.min(axis=1)).astype(int), 0)
    size = np.maximum(np.minimum(np.ceil(quads.max(axis=1)).astype(int) + 1, (w, h)) - low, 0)
    many = size[:, 0] * size[:, 1]
    part = np.cumsum(many) // PIXELS_AT_ONCE
    for g in np.split(np.arange(len(quads)), np.flatnonzero(np.diff(part)) + 1):
        g = g[many[g] > 0]
        box = np.repeat(np.arange(len(g)), many[g])
        y, x = np.divmod(_spans(many[g]), size[g, 0][box])
        y, x = y + low[g, 1][box], x + low[g, 0][box]
        value = heats[image[g][box], y, x]
        y, x = y + 0.5, x + 0.5
        least, most = np.full(len(box), np.inf), np.full(len(box), -np.inf)
        for i in range(4):
            p, q = quads[g, i], quads[g, (i + 1) % 4]
            side = (q[:, 0] - p[:, 0])[box] * (y - p[:, 1][box]) - (q[:, 1] - p[:, 1])[box] * (x - p[:, 0][box])
            least, most = np.minimum(least, side), np.maximum(most, side)
        inside = (least >= -1e-6) | (most <= 1e-6)
        found = np.bincount(box[inside], minlength=len(g))
        out[g] = np.bincount(box[inside], value[inside].astype(float), len(g)) / np.maximum(found, 1)
    return out


def regions_of(
    heats: np.ndarray, sources: np.ndarray, threshold: float = 0.2, box_threshold: float = 0.45, unclip: float = 1.4
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Image, position, quad, angle and score of the rotated text regions of a stack of heatmaps of one size.

    Quads are in pixels of each image's source (width, height); positions go in scan order. All images of the stack are
    worked on together.
    """
    n, h, w = heats.shape
    line, first, end, label = _runs(heats > threshold)
    length = np.bincount(label, end - first)
    some = length[label] >= MIN_PIXELS
    line, first, end, label = line[some], first[some], end[some], label[some]
    group, x, y = _convex_hulls(np.tile(label, 2), np.concatenate([first, end - 1]), np.tile(line % h, 2))
    corners = np.bincount(group, minlength=len(length))
    solid = corners[group] > 2
    region = np.flatnonzero(corners > 2)
    image = np.zeros(len(length), int)
    image[label] = line // h
    image = image[region]
    cx, cy, width, height, angle = min_area_rects(x[solid], y[solid], corners[region])
    keep = np.minimum(width, height) >= MIN_SIDE
    image, cx, cy, width, height, angle = (v[keep] for v in (image, cx, cy, width, height, angle))
    score = box_scores(heats, image, rect_quads(cx, cy, width, height, angle))
    grow = 2 * width * height * unclip / (2 * (width + height))
    width, height = width + grow, height + grow
    source = np.asarray(sources, float)[image][:, None, :]
    quads = np.clip(np.floor(rect_quads(cx, cy, width, height, angle) * (source / (w, h)) + 0.5), 0, source)
    span = np.ptp(quads, axis=1).min(axis=1)
    keep = ~(score < box_threshold) & (np.minimum(width, height) >= MIN_UNCLIPPED) & (span >= MIN_SCALED)
    image, quads, angle, score = (v[keep] for v in (image, quads, angle, score))
    position = _spans(np.bincount(image, minlength=n))
    keep = position < MAX_REGIONS
    return image[keep], position[keep], quads[keep], angle[keep], score[keep]


def extract_regions(
    heat: np.ndarray, source: tuple[int, int], threshold: float = 0.2, box_threshold: float = 0.45, unclip: float = 1.4
) -> list[dict]:
    """Rotated text regions of a heatmap in pixels of the source (width, height), in scan order."""
    _, _, quads, angles, scores = regions_of(heat[None], np.array([source]), threshold, box_threshold, unclip)
    low, span = quads.min(axis=1), np.ptp(quads, axis=1)
    return [
        {
            "quad": [{"x": float(x), "y": float(y)} for x, y in quads[i]], "x": float(low[i, 0]), "y": float(low[i, 1]),
            "width": float(span[i, 0]), "height": float(span[i, 1]), "angle": float(angles[i]), "score": float(scores[i]),
        }
        for i in range(len(quads))
    ]


def heatmap_regions(heatmaps: DataFrame, threshold: float = 0.2, box_threshold: float = 0.45, unclip: float = 1.4) -> DataFrame:
    """image_id, position, quad, x, y, width, height, angle, score.

    heatmaps: image_id, heat_width, heat_height, data (array of float; its last width*height values count),
    source_width, source_height. Every image is one row, so images spread over tasks without a shuffle; those of one size are
    worked on together.
    """
    shape = (
        "image_id long, position int, quad array<struct<x: double, y: double>>, x double, y double, width double, height double, "
        "angle double, score double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("image_id").cast(pa.int64())
            ws, hs, *sources = (b.column(c).to_numpy(zero_copy_only=False) for c in ("heat_width", "heat_height", "source_width", "source_height"))
            ws, hs, sources, data = ws.astype(int), hs.astype(int), np.stack(sources, axis=1), b.column("data")
            starts, ends = (np.asarray(data.offsets)[i : i + b.num_rows] for i in (0, 1))
            values = data.values.to_numpy(zero_copy_only=False)
            if b.column("heat_width").null_count or b.column("heat_height").null_count or ((ends - starts) < ws * hs).any():
                raise ValueError("a heatmap has no size or fewer values than pixels")
            for w, h in set(zip(ws.tolist(), hs.tolist())):
                same, step = np.flatnonzero((ws == w) & (hs == h)), max(1, PIXELS_AT_ONCE // (w * h))
                for rows in (same[i : i + step] for i in range(0, len(same), step)):
                    heats = np.stack([values[e - w * h : e] for e in ends[rows]]).astype(np.float32, copy=False).reshape(-1, h, w)
                    image, position, quads, angles, scores = regions_of(heats, sources[rows], threshold, box_threshold, unclip)
                    low, span = quads.min(axis=1), np.ptp(quads, axis=1)
                    points = pa.StructArray.from_arrays([pa.array(quads[:, :, i].reshape(-1)) for i in (0, 1)], ["x", "y"])
                    columns = [
                        ids.take(pa.array(rows[image])), pa.array(position, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(quads) + 1) * 4, pa.int32()), points),
                        *(pa.array(v) for v in (low[:, 0], low[:, 1], span[:, 0], span[:, 1], angles, scores)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["image_id", "position", "quad", "x", "y", "width", "height", "angle", "score"])

    return heatmaps.select("image_id", "heat_width", "heat_height", "data", "source_width", "source_height").mapInArrow(run, shape)


def resize_bilinear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def detection_tensor(rgb: np.ndarray, max_side: int) -> np.ndarray:
    """3 planes (blue, green, red) of the resized image, normalised by the usual means and deviations."""
    h, w = rgb.shape[:2]
    scale = min(1.0, max_side / max(h, w))
    side = lambda v: max(32, int(math.floor(v * scale / 32 + 0.5)) * 32)
    small = resize_bilinear(rgb.astype(np.float64), side(w), side(h)) / 255
    return ((small[..., ::-1] - IMAGENET_MEAN) / IMAGENET_STD).transpose(2, 0, 1).astype(np.float32)


def recognition_tensor(crops: list[np.ndarray], height: int = 48) -> np.ndarray:
    """A batch of crops at one height, values from -1 to 1, zeros to the right of narrower crops."""
    widths = [min(3200, max(1, math.ceil(height * c.shape[1] / c.shape[0]))) for c in crops]
    out = np.zeros((len(crops), 3, height, max(320, -(-max(widths) // 8) * 8)), np.float32)
    for i, (c, w) in enumerate(zip(crops, widths)):
        small = resize_bilinear(c.astype(np.float64), w, height) / 127.5 - 1
        out[i, :, :, :w] = small[..., ::-1].transpose(2, 0, 1)
    return out


def projective(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The 3x3 matrix that takes the corners of a width x height rectangle to the quad."""
    rows, rhs = [], []
    for (u, v), (x, y) in zip(((0, 0), (width, 0), (width, height), (0, height)), quad):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        rhs += [x, y]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1).reshape(3, 3)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours for cubic interpolation with a = -0.5."""
    a = -0.5
    d = np.abs(np.stack([t + 1, t, 1 - t, 2 - t]))
    return np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * (d**3 - 5 * d**2 + 8 * d - 4), 0))


def perspective_crop(rgb: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quad's content as an upright image, by bicubic sampling."""
    quad = np.asarray(quad, float)
    length = lambda p, q: float(np.hypot(*(quad[p] - quad[q])))
    width = max(1, round((length(0, 1) + length(3, 2)) / 2))
    height = max(1, round((length(0, 3) + length(1, 2)) / 2))
    m = projective(quad, width, height)
    v, u = np.mgrid[0:height, 0:width] + 0.5
    x, y, z = (m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)]))
    x, y = x / z - 0.5, y / z - 0.5
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = _cubic(x - x0), _cubic(y - y0)
    out = np.zeros((u.size, rgb.shape[2]))
    for j in range(4):
        yy = np.clip(y0 + j - 1, 0, rgb.shape[0] - 1)
        for i in range(4):
            xx = np.clip(x0 + i - 1, 0, rgb.shape[1] - 1)
            out += (wy[j] * wx[i])[:, None] * rgb[yy, xx]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).reshape(height, width, -1)


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB pixels of an uncompressed 24-bit BMP."""
    start = int.from_bytes(data[10:14], "little")
    w, h = int.from_bytes(data[18:22], "little"), int.from_bytes(data[22:26], "little", signed=True)
    if data[:2] != b"BM" or int.from_bytes(data[28:30], "little") != 24 or int.from_bytes(data[30:34], "little"):
        raise ValueError("only uncompressed 24-bit BMP images can be decoded here")
    row = -(-w * 3 // 4) * 4
    pixels = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * 3].reshape(abs(h), w, 3)[..., ::-1]
    return pixels[::-1] if h > 0 else pixels


def decode_png(data: bytes, max_pixels: int = 50_000_000) -> np.ndarray:
    """RGB pixels of a PNG with 8 bits a sample, not interlaced: grey, RGB or palette, with or without alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    chunks: dict[bytes, bytes] = {}
    at = 8
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunks[name] = chunks.get(name, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    head = chunks.get(b"IHDR", b"")
    if len(head) < 13:
        raise ValueError("PNG image without a header")
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[9])
    if head[8] != 8 or head[12] or samples is None or not 0 < w * h <= max_pixels:
        raise ValueError("this kind of PNG image can't be decoded here")
    try:
        raw = zlib.decompressobj().decompress(chunks.get(b"IDAT", b""), h * (w * samples + 1))
    except zlib.error as e:
        raise ValueError("damaged PNG image") from e
    if len(raw) != h * (w * samples + 1):
        raise ValueError("PNG image is cut off")
    rows = np.frombuffer(raw, np.uint8).reshape(h, w * samples + 1)
    out = np.zeros((h, w, samples), np.uint8)
    above = np.zeros((w, samples), np.int64)
    for y in range(h):
        above = _unfilter(int(rows[y, 0]), rows[y, 1:].reshape(w, samples).astype(np.int64), above)
        out[y] = above
    if head[9] == 3:
        palette = np.zeros((256, 3), np.uint8)
        given = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        palette[: len(given)] = given
        return palette[out[..., 0]]
    return out[..., :3] if samples > 2 else np.repeat(out[..., :1], 3, axis=2)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row's samples from its filtered ones and the row above."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0) % 256
    if kind == 2:
        return (row + above) % 256
    left, corner = np.zeros(row.shape[1], np.int64), np.zeros(row.shape[1], np.int64)
    out = np.empty_like(row)
    for x in range(len(row)):
        up = above[x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left = out[x] = (row[x] + guess) % 256
        corner = up
    return out


def decode_image(data: bytes) -> np.ndarray:
    """RGB pixels; an error for the formats that need a decoder which is not installed."""
    return decode_png(data) if data[:4] == b"\x89PNG" else decode_bmp(data)


def crop_regions(images: DataFrame, quads: DataFrame) -> DataFrame:
    """image_id, box_idx, width, height, pixels (RGB bytes) of each quad.

    images: image_id, content (PNG or BMP). quads: image_id, box_idx, quad. The join shuffles images once; a crop of no
    readable image has null pixels.
    """
    shape = "image_id long, box_idx long, width int, height int, pixels binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    image = decode_image(r.content)
                except ValueError:
                    rows += [(r.image_id, box["box_idx"], None, None, None) for box in r.boxes]
                    continue
                for box in r.boxes:
                    crop = perspective_crop(image, np.array([(p["x"], p["y"]) for p in box["quad"]]))
                    rows.append((r.image_id, box["box_idx"], crop.shape[1], crop.shape[0], crop.tobytes()))
            out = pd.DataFrame(rows, columns=["image_id", "box_idx", "width", "height", "pixels"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    boxes = quads.groupBy("image_id").agg(F.collect_list(F.struct("box_idx", "quad")).alias("boxes"))
    return images.join(boxes, "image_id").select("image_id", "content", "boxes").mapInPandas(run, shape)
