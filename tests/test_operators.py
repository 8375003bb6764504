"""Vectors of single operators, order independence and edge cases."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import evaluation, geometry, language, text
from pagewright.operators import boxes, ctc, ordering, overlaps, packing, raster, routing, validate
from pagewright.sources import documents, images, tsv
from pagewright.streaming import worker


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def array(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize(
    "ref, pred, chars, words",
    [("Привет мир", "Привет, мир", 1, 1), ("", "", 0, 0), ("", "text", 4, 1), ("a b", "", 3, 2), ("a\u00a0b b", "a b b", 1, 0), ("x x x", "x y x", 1, 1)],
)
def test_error_rates(spark, ref, pred, chars, words):
    e = one(spark, evaluation.evaluate(F.lit(ref), F.lit(pred)))
    assert (e.character_error.edits, e.word_error.edits, e.exact_match) == (chars, words, ref == pred)
    assert e.character_error.rate == (chars / len(ref) if ref else float(bool(pred)))


@pytest.mark.parametrize(
    "raw, code", [("ru-RU", "ru"), ("jpn", "ja"), ("chi_sim", "zh"), ("ko-KR", "ko"), ("kor", "ko"), ("deu", "de"), ("sr-Latn", "sr-latn"), (" EN ", "en")]
)
def test_language_codes(spark, raw, code):
    assert one(spark, language.normalize_language(F.lit(raw))) == code


@pytest.mark.parametrize("raw, code", [("zh-Hans", "chi_sim"), ("zh_TW", "chi_tra"), ("de-AT", "deu"), ("cze", "ces"), ("Xx-y", "xx-y")])
def test_language_codes_of_three_letters(spark, raw, code):
    assert one(spark, language.normalize_language3(F.lit(raw))) == code


def test_language_requests(spark):
    assert one(spark, language.resolve_languages(array("AUTO"))) == []
    assert one(spark, language.unsupported_languages(array("auto", "en"))) == ["auto"]
    assert one(spark, language.resolve_languages(array("deu", "ger", "EN"))) == ["de", "en"]
    assert one(spark, language.resolve_languages3(array(), array("osd", "fra"))) == ["fra"]
    assert one(spark, language.resolve_languages3(array(), array("fra", "eng"))) == ["eng"]
    assert one(spark, language.split_languages(F.lit("deu; en,,en"))) == ["de", "en"]


@pytest.mark.parametrize(
    "codes, plan",
    [([], "PLCK"), (["en"], "P"), (["de"], "L"), (["de", "en"], "L"), (["ru"], "C"), (["en", "ru"], "PC"), (["ko"], "K"), (["ja"], "P"), (["de", "zh"], "PL"), (["ru", "ko"], "PCK")],
)
def test_recognizer_plans(spark, codes, plan):
    p = one(spark, language.recognizer_plan(array(*codes)))
    assert "".join(k for k, on in zip("PLCK", (p.primary, p.latin, p.cyrillic, p.korean)) if on) == plan


@pytest.mark.parametrize("s, tag", [("한국어 2026", "Kore"), ("本地文字", "Hani"), ("ひらがな漢字", "Jpan"), ("Привет", "Cyrl"), ("Ωmega", "Latn"), ("12.5", None), ("", None)])
def test_script_tags(spark, s, tag):
    assert one(spark, text.script_tag(F.lit(s))) == tag


def test_script_fractions(spark):
    assert one(spark, text.script_fraction(F.lit("Нello"), "Cyrillic")) == 0.2
    assert one(spark, text.script_fraction(F.lit("×"), "Latin")) == 0
    assert one(spark, text.contains_script(F.lit("×"), "Latin")) is True
    assert one(spark, text.utrim(F.lit("\u00a0 a b\t\u3000"))) == "a b"
    assert one(spark, text.file_stem(F.lit("/a/b.c.png"))) == "b.c"


def test_line_language(spark):
    assert [one(spark, language.line_language(F.lit(s), array(*h))) for s, h in [("日本語かな", []), ("안녕하세요", []), ("Hello", []), ("Hello", ["de", "ru"]), ("Hello", ["de", "fr"])]] == ["ja", "ko", None, "de", None]


def candidates(spark, rows):
    return spark.createDataFrame([(0, 0, *r) for r in rows], "image_id long, box_idx long, recognizer string, text string, confidence double")


@pytest.mark.parametrize("flip", [False, True])
def test_candidate_selection(spark, flip):
    rows = [("primary", "Hello", 0.95), ("cyrillic", "Нello", 0.78), ("latin", "Hello", 0.81)]
    best = routing.select_candidates(candidates(spark, rows[::-1] if flip else rows)).first()
    assert (best.recognizer, best.text, best.alternatives) == ("primary", "Hello", [])
    best = routing.select_candidates(candidates(spark, [("primary", "abc", 0.9), ("latin", "abd", 0.9), ("korean", "abe", 0.95)])).first()
    assert (best.text, [a.text for a in best.alternatives]) == ("abd", ["abc", "abe"])
    assert routing.select_candidates(candidates(spark, [("primary", "x", float("nan")), ("latin", "y", 0.5)])).count() == 0


def test_specialist_routing(spark):
    c = lambda conf, s: one(spark, routing.auto_specialist(F.lit("Hello"), F.lit(conf), s))
    assert [c(0.995, s) for s in ("Latin", "Cyrillic", "Korean")] == [True, False, False]
    assert all(c(0.98, s) for s in ("Latin", "Cyrillic", "Korean"))
    assert one(spark, routing.selective_specialist(F.lit(None).cast("string"), F.lit(None).cast("double"))) is True


TILES = {(2400, 1280): [0, 1120], (4000, 1280): [0, 906, 1813, 2720], (2560, 1280): [0, 640, 1280], (3840, 1280): [0, 853, 1706, 2560], (5120, 1280): [0, 960, 1920, 2880, 3840]}


def test_tile_offsets(spark):
    rows = spark.createDataFrame(list(TILES), "len long, tile long").select("len", "tile", boxes.tile_offsets(F.col("len"), F.col("tile")).alias("o")).collect()
    assert {(r.len, r.tile): r.o for r in rows} == TILES
    assert one(spark, boxes.should_tile(F.lit(1280), F.lit(1920), F.lit(1280))) is False
    assert one(spark, boxes.should_tile(F.lit(1080), F.lit(2400), F.lit(1280))) is True


@pytest.mark.parametrize("tile", [2, 8, 64, 960])
def test_tiles_cover_every_length(spark, tile):
    rows = spark.range(1, 5 * tile + 2).select("id", boxes.tile_offsets(F.col("id"), F.lit(tile)).alias("o")).collect()
    for r in rows:
        assert r.o[0] == 0 and r.o[-1] == max(0, r.id - tile)
        assert all(0 < b - a <= tile - max(tile // 8, 1) for a, b in zip(r.o, r.o[1:]))


def lines(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], "image_id long, position long, x double, y double, width double, height double")


def test_reading_order(spark):
    got = ordering.reading_order(lines(spark, [(200, 12, 50, 20), (10, 10, 80, 20), (15, 80, 50, 20)])).orderBy("order").collect()
    assert [r.position for r in got] == [1, 0, 2]
    drift = [(300 - 50 * i, 8 * i, 40, 20) for i in range(5)]
    for n in (1, 7):
        got = ordering.reading_order(lines(spark, drift).repartition(n)).collect()
        assert len({r.row for r in got}) == 1
    ties = ordering.reading_order(lines(spark, [(5, 5, 5, 5)] * 4)).orderBy("order").collect()
    assert [r.position for r in ties] == [0, 1, 2, 3]


def test_overlaps(spark):
    kept = overlaps.drop_overlaps(lines(spark, [(10, 10, 90, 20), (11, 10, 90, 20), (10, 35, 90, 20), (12, 36, 5, 0)]))
    assert sorted(r.position for r in kept.collect()) == [0, 2, 3]


def test_width_batches(spark):
    crops = spark.createDataFrame([(0, i, w) for i, w in enumerate([100, 100, 120, 400, 3000])], "image_id long, box_idx long, width long")
    got = {r.box_idx: r.batch for r in packing.width_batches(crops, 8, 8192).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def test_rebuild_text(spark):
    rows = [(0, 1, 1, " second ", None, False), (0, 0, 0, "first", "First!", False), (0, 2, 2, "no", None, True), (0, 3, 3, "\u00a0", None, False)]
    df = spark.createDataFrame(rows, "image_id long, order long, position long, text string, corrected_text string, ignored boolean")
    assert tuple(ordering.rebuild_text(df).first()) == (0, "first\nsecond", "First!\nsecond")


def row(*values):
    return "\t".join(map(str, values))


def test_tsv(spark):
    body = [
        "header", row(1, 1, 0, 0, 0, 0, 0, 0, 200, 100, -1, ""), row(5, 1, 1, 1, 1, 1, 10, 10, 40, 20, 90, "Hello"),
        row(5, 1, 1, 1, 1, 2, 60, 10, 50, 20, 80, "world"), "", row(5, 1, 2, 1, 1, 1, 10, 50, 70, 20, 95, "Привет"),
    ]
    df = spark.createDataFrame([("a", "\n".join(body))], "image_id string, tsv string")
    rows = tsv.read_tsv_lines(df)
    got = tsv.tsv_text_lines(tsv.tsv_words(rows, 0.0)).orderBy("line_id").collect()
    assert [r.text for r in got] == ["Hello world", "Привет"] and got[0].width == 100
    assert [w.id for w in got[0].words] == ["line-0001-word-0001", "line-0001-word-0002"]
    assert [r.text for r in tsv.tsv_text_lines(tsv.tsv_words(rows, 0.85)).orderBy("line_id").collect()] == ["Hello", "Привет"]
    assert tuple(tsv.tsv_pages(rows).first()) == ("a", 200.0, 100.0)
    bad = spark.createDataFrame([("b", "h\n" + row(5, 1, 1) + "\n" + row("x", *[1] * 10, "t") + "\n" + row(5, *[1] * 10, "a\tb"))], "image_id string, tsv string")
    errors = [r.error for r in tsv.read_tsv_lines(bad).orderBy("position").collect()]
    assert errors == ["line 2: expected 12 columns", "line 3: invalid level", None]
    assert one(spark, tsv.installed_languages(F.lit("List of available languages (2):\neng\nosd\n"))) == ["eng", "osd"]


def test_ctc(spark):
    steps = [(0, s, t, 0.5) for s, t in enumerate([1, 1, 0, 1, 2, 2, 3, 0])] + [(1, 0, 0, 0.9)]
    df = spark.createDataFrame(steps, "item long, step int, token int, score double")
    entries = spark.createDataFrame([(1, "a"), (2, "b"), (3, " ")], "token int, entry string")
    items = spark.createDataFrame([(0,), (1,), (2,)], "item long")
    got = {r.item: (r.text, r.confidence) for r in ctc.ctc_decode(df, entries, items).collect()}
    assert got == {0: ("aab ", 0.5), 1: ("", 0.0), 2: ("", 0.0)}
    tie = spark.createDataFrame([(0, 0, t, 1.0) for t in range(3)], "item long, step int, token int, score double")
    assert ctc.best_tokens(tie).first().token == 2


def test_word_boxes(spark):
    def words(s, columns, n):
        df = spark.createDataFrame([(s, columns, n)], "t string, c array<int>, n int")
        centres = ctc.character_centres(F.col("t"), F.col("c"), F.col("n"), F.lit(4.0), F.lit(4.0), F.lit(None).cast("array<double>"))
        quad = geometry.quad_from_rect(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(10.0))
        return df.withColumn("m", centres).select(ctc.word_boxes(quad, F.col("t"), F.col("m")).alias("b")).first().b

    two = words("two words", list(range(9)), 10)
    assert len(two) == 2 and two[0][1].x <= two[1][0].x
    assert words("a b", [0, 9, 10], 2) is None
    assert words("ab", [0], 2) is None


def test_geometry(spark):
    quad = geometry.quad_from_rect(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(3.0))
    assert one(spark, geometry.area(quad)) == 12
    assert one(spark, geometry.point_in_quad(F.lit(2.0), F.lit(3.0), quad)) is True
    assert one(spark, geometry.point_in_quad(F.lit(9.0), F.lit(3.0), quad)) is False
    assert one(spark, geometry.normalize_angle(F.lit(math.pi))) == pytest.approx(0)
    assert one(spark, geometry.normalize_angle(F.lit(-math.pi / 2))) == pytest.approx(math.pi / 2)
    assert one(spark, geometry.quad_from_points(F.slice(quad, 1, 0), F.lit(9.0), F.lit(9.0))) is None
    assert one(spark, geometry.recognition_width(F.lit(100), F.lit(48))) == 100
    assert one(spark, geometry.padded_width(F.lit(321))) == 328
    assert tuple(one(spark, geometry.detection_size(F.lit(2000), F.lit(500), F.lit(1280)))) == (1280, 320)


def test_rectangles_and_regions():
    a = math.pi / 7
    quad = raster.rect_quad(50, 40, 40, 10, a)
    cx, cy, w, h, angle = raster.min_area_rect(raster.convex_hull(quad))
    assert (cx, cy, w, h, angle) == pytest.approx((50, 40, 40, 10, a), abs=1e-6)
    heat = np.zeros((32, 64), np.float32)
    heat[10:18, 12:44] = 0.93
    (r,) = raster.extract_regions(heat, (640, 320))
    assert r["width"] > 300 and r["height"] > 80 and r["score"] > 0.9
    assert raster.extract_regions(np.zeros((8, 8), np.float32), (8, 8)) == []


def test_components_match_a_flood():
    rng = np.random.default_rng(1)
    mask = rng.random((40, 50)) < 0.4
    labels = raster.components(mask)
    seen, want = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        want += 1
        stack = [(y, x)]
        seen[y, x] = want
        while stack:
            a, b = stack.pop()
            for i in range(max(0, a - 1), min(40, a + 2)):
                for j in range(max(0, b - 1), min(50, b + 2)):
                    if mask[i, j] and not seen[i, j]:
                        seen[i, j] = want
                        stack.append((i, j))
    assert (labels == seen).all()


def test_hulls_of_many_groups():
    rng = np.random.default_rng(3)
    points = [rng.integers(0, 3 + n % 50, (3 + n % 40, 2)) for n in range(200)]
    n = np.arange(200)
    points += [np.stack([np.append(n, 200), np.append(n * n, -(10**6))], axis=1)]  # loses one point a round
    group = np.repeat(np.arange(len(points)), [len(p) for p in points])
    mixed = rng.permutation(len(group))
    x, y = np.concatenate(points).T
    g, hx, hy = raster._convex_hulls(group[mixed], x[mixed], y[mixed])
    assert (np.diff(g) >= 0).all()
    for k, p in enumerate(points):
        hull = raster.convex_hull(p)
        assert (g == k).sum() == len(hull) or len(hull) < 3
        assert len(hull) < 3 or (np.stack([hx[g == k], hy[g == k]], axis=1) == hull).all()


def test_regions_of_a_stack_are_those_of_each_image():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:50, 0:70]
    heats = np.zeros((40, 50, 70), np.float32)
    for heat in heats[1:]:
        for _ in range(rng.integers(1, 6)):
            a, cx, cy = rng.random() * math.pi, rng.random() * 70, rng.random() * 50
            along, across = (x - cx) * math.cos(a) + (y - cy) * math.sin(a), (y - cy) * math.cos(a) - (x - cx) * math.sin(a)
            heat[(abs(along) < 4 + rng.random() * 20) & (abs(across) < 2 + rng.random() * 5)] = 0.3 + 0.7 * rng.random()
    sources = rng.integers(200, 900, (40, 2))
    image, position, quads, angles, scores = raster.regions_of(heats, sources)
    for i, heat in enumerate(heats):
        labels, want = raster.components(heat > 0.2), []
        for k in range(1, labels.max() + 1):
            rows, columns = np.nonzero(labels == k)
            hull = raster.convex_hull(np.stack([columns, rows], axis=1))
            if len(rows) < 4 or len(hull) < 3:
                continue
            cx, cy, w, h, angle = raster.min_area_rect(hull)
            quad = raster.rect_quad(cx, cy, w, h, angle)
            turns = [(q - p)[0] * (y + 0.5 - p[1]) - (q - p)[1] * (x + 0.5 - p[0]) for p, q in zip(quad, np.roll(quad, -1, axis=0))]
            inside = np.min(turns, axis=0) >= -1e-6
            score = heat[inside].mean(dtype=float) if inside.any() else 0.0
            grow = w * h * 1.4 / (w + h)
            out = np.clip(np.floor(raster.rect_quad(cx, cy, w + grow, h + grow, angle) * (sources[i] / (70, 50)) + 0.5), 0, sources[i])
            if min(w, h) >= 3 and score >= 0.45 and min(w, h) + grow >= 5 and np.ptp(out, axis=0).min() >= 4:
                want.append((out.tolist(), pytest.approx(angle, abs=1e-12), pytest.approx(score, abs=1e-9)))
        at = image == i
        assert list(zip(quads[at].tolist(), angles[at], scores[at])) == want and (position[at] == np.arange(len(want))).all()
    assert len(image) > 40


def test_many_heatmaps_take_little_time(spark):
    heats = np.zeros((2000, 32, 64), np.float32)
    for k in range(2000):
        heats[k, 8:18, k * 7 % 20 : k * 7 % 20 + 24] = 0.93
    start = time.process_time()
    assert len(raster.regions_of(heats, np.full((2000, 2), 320))[0]) == 2000
    assert time.process_time() - start < 2  # 0.15 s; image by image 7 s
    rows = [(i, w, h, [9.0] + [0.93] * (w * h), w, h) for i, (w, h) in enumerate([(8, 8), (9, 7), (8, 8), (2, 2), (9, 7)])] + [(None, 8, 8, [0.93] * 64, 8, 8)]
    df = spark.createDataFrame(rows, "image_id long, heat_width int, heat_height int, data array<float>, source_width int, source_height int").coalesce(1)
    got = sorted((repr(r.image_id), r.position, r.x, r.y, r.width, r.height, len(r.quad)) for r in raster.heatmap_regions(df).collect())
    assert got == sorted((repr(i), 0, 0.0, 0.0, w, h, 4) for i, w, h in [(0, 8.0, 8.0), (1, 9.0, 7.0), (2, 8.0, 8.0), (4, 9.0, 7.0), (None, 8.0, 8.0)])


def test_crops_and_tensors(spark):
    pixels = np.arange(6 * 4 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert (raster.perspective_crop(pixels, np.array([(0, 0), (6, 0), (6, 4), (0, 4)])) == pixels).all()
    assert raster.detection_tensor(pixels, 960).shape == (3, 32, 32)
    assert raster.recognition_tensor([pixels]).shape == (1, 3, 48, 320)
    rows = np.zeros((4, 20), np.uint8)
    rows[:, :18] = pixels[::-1, :, ::-1].reshape(4, 18)
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (6).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24)
    content = head + rows.tobytes()
    assert (raster.decode_bmp(content) == pixels).all()
    files = spark.createDataFrame([(1, bytearray(content)), (2, bytearray(b"no"))], "image_id long, content binary")
    quad = geometry.quad_from_rect(F.lit(0.0), F.lit(0.0), F.lit(6.0), F.lit(4.0))
    got = {r.image_id: r for r in raster.crop_regions(files, files.select("image_id", F.lit(0).cast("long").alias("box_idx"), quad.alias("quad"))).collect()}
    assert bytes(got[1].pixels) == pixels.tobytes() and got[2].pixels is None


def test_png_decoding():
    import zlib

    rng = np.random.default_rng(2)
    for kind, samples in ((2, 3), (6, 4), (0, 1), (4, 2)):
        image = rng.integers(0, 256, (7, 5, samples))
        lines_, above = [], np.zeros((5, samples), int)
        for y, row in enumerate(image):
            left = np.vstack([np.zeros((1, samples), int), row[:-1]])
            corner = np.vstack([np.zeros((1, samples), int), above[:-1]])
            p = left + above - corner
            d = np.abs(np.stack([p - left, p - above, p - corner]))
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
            guess = [0, left, above, (left + above) // 2, paeth][y % 5]
            lines_.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
            above = row
        chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + b"crc."
        head = (5).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines_))) + chunk(b"IEND", b"")
        want = image[..., :3] if samples > 2 else np.repeat(image[..., :1], 3, axis=2)
        assert (raster.decode_image(data) == want).all(), kind
        with pytest.raises(ValueError):
            raster.decode_image(data[:60])


def document_json(**changes):
    base = {
        "schema_version": "annotation.v1", "coordinate_system": "pixel_top_left", "image": {"id": "i", "file_name": "i.png", "width": 20, "height": 10},
        "text": "Hi", "lines": [], "language_hints": ["en"], "metadata": {"status": "draft"},
    }
    return base | changes


def document(spark, **changes):
    import json

    return documents.parse_documents(spark.createDataFrame([(json.dumps(document_json(**changes)),)], "json string")).first()


def test_strict_documents(spark):
    assert document(spark).errors == []
    assert document(spark, extra=1).errors == ["unknown member extra"]
    bad = document(spark, image={"id": " ", "file_name": "f", "width": 0, "height": 1, "sha256": "ABC"}, language_hints=["en", "en"]).errors
    assert [next((e for e in bad if k in e), None) is not None for k in ("image.id", "width and height", "image.sha256", "language_hints[1]")] == [True] * 4
    line = {
        "id": "l", "order": 0, "quad": {"points": [{"x": 0, "y": 0}, {"x": 5, "y": 0}, {"x": 5, "y": 5}, {"x": 0, "y": 5}]}, "text": "", "direction": "auto",
        "legibility": "clear", "evaluation": {"detection": True, "recognition": True}, "source": "manual", "words": [], "ignored": False,
        "alternatives": [{"text": "x", "confidence": 1.5}],
    }
    errors = document(spark, lines=[line, line], metadata={"status": "reviewed"}).errors
    for part in ("alternatives[0].confidence", "lines[0].text must not be empty", "order 0 is duplicated", "id l is duplicated", "text differs"):
        assert any(part in e for e in errors), (part, errors)
    assert documents.parse_documents(spark.createDataFrame([("[1",)], "json string")).first().errors == ["not a JSON object"]


def test_strict_values(spark):
    quad = {"points": [{"x": 0, "y": 0}, {"x": 5, "y": 0}, {"x": 5, "y": 5}, {"x": 0, "y": 5}]}
    line = {
        "id": "l", "order": 0, "quad": quad, "text": "", "direction": "auto", "legibility": "clear", "evaluation": {"detection": True, "recognition": True},
        "source": "manual", "words": [], "ignored": False, "alternatives": [], "confidence": None,
    }
    assert document(spark, lines=[line]).errors == []
    wrong = {
        "metadata.status is none of": {"metadata": {"status": "bogus"}}, "lines.order is out of range": {"lines": [line | {"order": -1}]},
        "lines.ignored must be true or false": {"lines": [line | {"ignored": "yes"}]}, "text must be text": {"text": 5},
        "lines.direction is none of": {"lines": [line | {"direction": "up"}]}, "lines.source is none of": {"lines": [line | {"source": "x"}]},
        "lines.legibility must be text": {"lines": [line | {"legibility": None}]}, "image.width must be a whole number": {"image": {"id": "i", "file_name": "f", "width": 1.5, "height": 10}},
        "language_hints must be an array": {"language_hints": ["en", 3]}, "lines.flags must be": {"lines": [line | {"flags": None}]},
        "coordinate_system is none of": {"coordinate_system": "x"}, "schema_version is not": {"schema_version": "any.annotation.v1"},
        "lines.quad.points.x must be a number": {"lines": [line | {"quad": {"points": [{"x": "1", "y": 0}, *quad["points"][1:]]}}]},
    }
    import json

    rows = [(m, json.dumps(document_json(**change))) for m, change in wrong.items()]
    for r in documents.parse_documents(spark.createDataFrame(rows, "message string, json string")).collect():
        assert any(r.message in e for e in r.errors), (r.message, r.errors)
    firsts = documents.parse_documents(spark.createDataFrame(rows, "message string, json string"), version="any.annotation.v1", first_only=True).collect()
    assert [len(r.errors) for r in firsts] == [int(r.message != "schema_version is not") or 0 for r in firsts]


def test_sinks_and_images(spark, tmp_path):
    row = documents.parse_documents(documents.read_documents(spark, __file__)).first()
    assert row.errors == ["not a JSON object"]
    docs = spark.createDataFrame([("a\nb",)], "text string").select(F.struct("text").alias("doc"))
    documents.write_documents(docs, str(tmp_path / "out"), "text")
    with pytest.raises(Exception):
        documents.write_documents(docs, str(tmp_path / "out"), "text")
    (tmp_path / "x.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452000000020000000308"))
    (tmp_path / "empty.png").write_bytes(b"")
    got = images.read_images(spark, str(tmp_path / "*.png")).collect()
    assert [(r.image_id, r.file_name) for r in got] == [("x", "x.png")]


def test_worker_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"id": 1, "method": "info"}\nbad\n')
    for _ in range(2):  # a second run answers nothing again
        worker.serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    lines_ = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines_ == ['{"id":1,"ok":true,"result":{"method":"info","languages":[]}}', '{"ok":false,"error":"request is not a JSON object"}']


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(__file__).parents[1] / "pagewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "pagewright.llm" not in p.read_text(), p
