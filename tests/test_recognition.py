"""The whole way from detections to documents on small tables, against expectations written out by hand."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import recognition
from pagewright.schema import ANNOTATION

IMAGES = "image_id long, file_name string, width int, height int, languages array<string>, quality string"
DETECTIONS = "image_id long, tile_no int, position long, points array<struct<x: double, y: double>>"
READINGS = "image_id long, tile_no int, position long, recognizer string, text string, confidence double, columns array<int>, sequence_length int"


def rect(x, y, w, h):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def run(spark, images, detections, readings, **options):
    tables = [spark.createDataFrame(rows, schema).withColumn("extra", F.lit(1)) for rows, schema in ((images, IMAGES), (detections, DETECTIONS), (readings, READINGS))]
    found = recognition.recognize_documents(*tables, **options)
    assert found.schema["doc"].dataType.simpleString() == ANNOTATION.simpleString()
    return {r.image_id: r for r in found.collect()}


def reading(image, position, recognizer, text, confidence, tile=0):
    return (image, tile, position, recognizer, text, confidence, list(range(len(text or ""))), len(text or "") + 2)


def test_routes_words_and_order(spark):
    images = [(1, "a.png", 400, 300, ["auto"], "balanced"), (2, "b.png", 400, 300, ["de"], "fast"), (3, "c.png", 400, 300, ["ru"], "balanced")]
    detections = [(1, 0, 0, rect(200, 10, 100, 20)), (1, 0, 1, rect(10, 12, 100, 20)), (1, 0, 2, rect(10, 100, 0, 20)), (1, 0, 3, rect(350, 200, 100, 20)), (2, 0, 0, rect(0, 0, 50, 20)), (3, 0, 0, rect(0, 0, 50, 20))]
    readings = [
        reading(1, 0, "primary", "two words", 0.995), reading(1, 0, "latin", "not seen", 1.0 - 1e-9), reading(1, 0, "cyrillic", "never", 1.0),
        reading(1, 1, "primary", "Нет", 0.9), reading(1, 1, "latin", "Het", 0.95), reading(1, 1, "cyrillic", "Нет!", 0.95), reading(1, 1, "korean", "  ", 1.0),
        reading(1, 2, "primary", "no crop", 1.0), reading(1, 3, "primary", "edge", 0.85), reading(1, 3, "korean", "ed", 0.5),
        reading(2, 0, "latin", "Straße", 0.9), reading(2, 0, "primary", "not asked", 1.0), reading(3, 0, "cyrillic", "да", 0.81), reading(3, 0, "primary", "not asked", 1.0),
    ]
    got = run(spark, images, detections, readings)
    one = got[1].doc
    assert [(n.id, n.order, n.text) for n in one.lines] == [("line-0002", 0, "Het"), ("line-0001", 1, "not seen"), ("line-0003", 2, "edge")]
    assert [(a.text, round(a.confidence, 6)) for a in one.lines[0].alternatives] == [("Нет!", 0.95), ("Нет", 0.9)]  # equal rank: the Latin pack goes first
    assert one.text == "Het\nnot seen\nedge" and got[1].errors == []
    words = one.lines[1].words
    assert [(w.id, w.text) for w in words] == [("line-0001-word-0001", "not"), ("line-0001-word-0002", "seen")] and words[0].quad.points[0].x == 200.0 and words[1].quad.points[1].x == 300.0
    assert max(p.x for p in one.lines[2].quad.points) == 400.0
    assert [n.text for n in got[2].doc.lines] == ["Straße"] and got[2].doc.lines[0].language == "de" and got[2].doc.metadata.engine.model == "v6-tiny-rec"
    assert [n.text for n in got[3].doc.lines] == ["да"] and got[3].doc.lines[0].script == "Cyrl"


def test_tiles_overlap_and_refusals(spark):
    images = [(1, "long.png", 500, 3000, [], "balanced"), (2, "x.png", 10, 10, ["xx", "yy"], "balanced"), (3, "y.png", 10, 10, ["ja"], "fast"), (4, "z.png", 10, 10, [], "best"), (5, "none.png", 10, 10, [], "fast")]
    detections = [(1, 0, 0, rect(10, 1000, 100, 20)), (1, 1, 0, rect(11, 140, 100, 20)), (1, 2, 0, rect(10, 0, 100, 20)), (1, 7, 0, rect(0, 0, 50, 50))]
    readings = [reading(1, 0, "primary", "first", 1.0, 0), reading(1, 0, "primary", "again", 1.0, 1), reading(1, 0, "primary", "last", 1.0, 2), reading(1, 0, "primary", "no tile", 1.0, 7)]
    got = run(spark, images, detections, readings, engine={"name": "x"})
    assert [(n.text, n.quad.points[0].y) for n in got[1].doc.lines] == [("first", 1000.0), ("last", 1720.0)] and got[1].doc.metadata.engine.name == "x"
    assert got[2].doc is None and got[2].errors == ["unsupported languages xx, yy"] and got[3].errors == ["no fast profile reads ja"] and got[4].errors == ["unknown quality best"]
    assert got[5].doc.lines == [] and got[5].doc.text == "" and got[5].errors == []
    assert run(spark, [], detections, readings) == {}
    with pytest.raises(ValueError):
        run(spark, images, detections, readings, min_confidence=2)
