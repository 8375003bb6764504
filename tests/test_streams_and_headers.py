"""Image headers of built files, matched responses, progress and percentiles."""

import datetime as dt
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import evaluation, language
from pagewright.functions.geometry import translate
from pagewright.sources import documents, images
from pagewright.streaming import correlate, progress, worker


def exif(turn, order=">", extra=()):
    entries = [*extra, (0x0112, 3, turn)]
    body = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in entries)
    return (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "IH", 8, len(entries)) + body + b"\0" * 4


def jpeg(w, h, turn=None, frame=0xC0, before=b""):
    app1 = b"" if turn is None else b"\xff\xe1" + struct.pack(">H", len(exif(turn)) + 8) + b"Exif\0\0" + exif(turn)
    return b"\xff\xd8" + before + app1 + b"\xff\xff" + bytes([0xFF, frame]) + struct.pack(">HBHH", 17, 8, h, w) + b"\3" + b"\0" * 9 + b"\xff\xda\0\2 data \xff\xc0 more"


def webp(chunk, after=b""):
    return b"RIFF" + struct.pack("<I", 4 + len(chunk) + len(after)) + b"WEBP" + chunk + after


def png(w, h, chunks=b""):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", w, h, 8, 2, 0, 0, 0, 0) + chunks


EXTENDED = b"VP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + struct.pack("<I", 4999)[:3] + struct.pack("<I", 2999)[:3]
FILES = {
    "jpeg plain": (jpeg(640, 480), ("jpeg", 640, 480, 1)), "jpeg turned": (jpeg(640, 480, 6, 0xC2), ("jpeg", 640, 480, 6)),
    "jpeg long": (jpeg(9, 7, 8, before=b"\xff\xe2\xff\xff" + b"\xff\xc0" * 32766 + b"x"), ("jpeg", 9, 7, 8)), "jpeg tables": (jpeg(5, 6, before=b"\xff\xc4\0\4ab\xff\xdb\0\2"), ("jpeg", 5, 6, 1)),
    "jpeg cut": (jpeg(640, 480)[:8], ("jpeg", None, None, 1)), "jpeg bad value": (jpeg(3, 4, 9), ("jpeg", 3, 4, 1)), "jpeg no frame": (b"\xff\xd8\xff\xd9", ("jpeg", None, None, 1)),
    "tiff little": (exif(5, "<", ((0x0100, 4, 70000), (0x0101, 3, 50))), ("tiff", 70000, 50, 5)), "tiff big": (exif(3, ">", ((0x0100, 3, 70), (0x0101, 4, 50))), ("tiff", 70, 50, 3)),
    "tiff no size": (exif(2), ("tiff", None, None, 2)), "tiff cut": (b"II*\0\xff\xff", ("tiff", None, None, 1)),
    "webp plain": (webp(b"VP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320 | 0x4000, 200)), ("webp", 320, 200, 1)),
    "webp lossless": (webp(b"VP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 319 | 199 << 14)), ("webp", 320, 200, 1)),
    "webp extended": (webp(EXTENDED, b"ICCP" + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(exif(7, "<"))) + exif(7, "<")), ("webp", 5000, 3000, 7)),
    "webp exif head": (webp(EXTENDED, b"EXIF" + struct.pack("<I", 6 + len(exif(8))) + b"Exif\0\0" + exif(8)), ("webp", 5000, 3000, 8)),
    "png": (png(12, 34), ("png", 12, 34, 1)), "png turned": (png(12, 34, struct.pack(">I4s", 2, b"gAMA") + b"ab\0\0\0\0" + struct.pack(">I4s", len(exif(6)), b"eXIf") + exif(6)), ("png", 12, 34, 6)),
    "bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 9, -8), ("bmp", 9, 8, 1)), "none": (b"GIF89a", (None, None, None, 1)), "empty": (b"", (None, None, None, 1)),
}


def test_headers(spark):
    df = spark.createDataFrame([(n, bytearray(f)) for n, (f, _) in FILES.items()], "name string, content binary").select("name", images.image_header(F.col("content")).alias("h"))
    for r in df.collect():
        kind, w, h, turn = FILES[r.name][1]
        size = r.h.size
        assert (r.h.format, size and size.width, size and size.height, r.h.orientation) == (kind, w, h, turn), r.name
        assert (r.h.shown and tuple(r.h.shown)) == (None if w is None else (h, w) if turn >= 5 else (w, h)), r.name
    with pytest.raises(ValueError):
        images.image_errors(F.lit(None), max_bytes=0)


T0 = dt.datetime(2024, 1, 1)
REQUESTS = [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 3), ("a", 4, 4), (None, 5, 5), ("a", 6, 6)]
RESPONSES = [
    ("a", 1, 5, True, None), ("a", 1, 6, False, "again"), ("b", 2, 5, True, None), ("a", 2, 90, True, None), ("a", 3, 7, False, "bad image"), ("b", 1, 9, False, None), ("c", 9, 9, True, None),
    ("a", 4, 3, True, None), ("a", 4, 8, True, None), (None, 5, 8, True, None),
]
OUTCOMES = sorted(
    [("a", 1, "ok", None), ("a", 2, "timed out", "no response within 30 seconds"), ("a", 3, "failed", "bad image"), ("b", 1, "failed", "request failed"), ("a", 4, "ok", None), (None, 5, "timed out", "no response within 30 seconds"), ("a", 6, "timed out", "no response within 30 seconds")],
    key=repr,
)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def outcomes(rows):
    return sorted(((r.worker, r.id, r.status, r.error) for r in rows), key=repr)


def test_responses_of_a_batch(spark):
    requests = spark.createDataFrame([(w, i, at(t)) for w, i, t in REQUESTS], "worker string, id long, ts timestamp")
    responses = spark.createDataFrame([(w, i, at(t), ok, e) for w, i, t, ok, e in RESPONSES], "worker string, id long, ts timestamp, ok boolean, error string")
    assert outcomes(correlate.correlate(requests, responses).collect()) == OUTCOMES


def feed(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_responses_of_a_stream(spark, tmp_path):
    """Missing, late, repeated and foreign responses, over several batches; a last pair moves the watermark on."""
    requests, responses = tmp_path / "requests", tmp_path / "responses"
    feed(requests, "0.json", [{"worker": w, "id": i, "ts": str(at(t))} for w, i, t in REQUESTS])
    feed(responses, "0.json", [{"worker": w, "id": i, "ts": str(at(t)), "ok": ok, "error": e} for w, i, t, ok, e in RESPONSES if t < 60])
    read = lambda p, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).json(str(p))
    found = correlate.correlate(read(requests, "worker string, id long, ts timestamp"), read(responses, "worker string, id long, ts timestamp, ok boolean, error string"))

    def run():
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    run()
    for n, late in ((1, 200), (2, 400)):
        feed(requests, f"{n}.json", [{"worker": "end", "id": n, "ts": str(at(late))}])
        feed(responses, f"{n}.json", [{"worker": w, "id": i, "ts": str(at(t)), "ok": ok, "error": e} for w, i, t, ok, e in RESPONSES if t >= 60] + [{"worker": "end", "id": n, "ts": str(at(late)), "ok": True}])
        run()
    got = [r for r in outcomes(spark.read.parquet(str(tmp_path / "out")).collect()) if r[0] != "end"]
    assert got == OUTCOMES


EVENTS = [("s", "a", 10.0), ("s", "a", 4.0), ("s", "b", 50.0), ("t", "zz", 9.0), ("t", "a", None), ("u", "a", 500.0), ("u", "b", 500.0), (None, "b", 25.0), ("s", "b", 60.0)]


def test_progress_of_batch_and_stream(spark, tmp_path):
    parts = {"a": 100, "b": 100}
    batch = progress.download_progress(spark.createDataFrame(EVENTS, "session string, artifact string, loaded double"), spark.createDataFrame(list(parts.items()), "artifact string, bytes long"))
    want = {r.session: (r.loaded, r.progress) for r in batch.collect()}
    assert want == {"s": (70.0, pytest.approx(0.315)), "t": (0.0, 0.0), "u": (1000.0, 0.9), None: (25.0, pytest.approx(0.1125))}
    for n, rows in enumerate((EVENTS[:4], EVENTS[4:])):
        feed(tmp_path / "events", f"{n}.json", [{"session": s, "artifact": a, "loaded": v} for s, a, v in rows])
    seen = {}
    stream = progress.progress_stream(spark.readStream.schema("session string, artifact string, loaded double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "events")), parts)
    keep = lambda df, _: seen.update({r.session: (r.loaded, r.progress) for r in df.collect()})
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {k: pytest.approx(v) for k, v in want.items()} == seen
    states = spark.createDataFrame([("s", "a", "loading", 0.5), ("s", "b", "cached", None), ("t", "a", "loading", 7.0), ("u", "zz", "ready", 1.0)], "session string, model string, status string, progress double")
    boot = progress.boot_progress(states, spark.createDataFrame([("a", 300), ("b", 100)], "model string, bytes long"))
    assert {r.session: r.progress for r in boot.collect()} == {"s": 0.625, "t": 0.75, "u": 0.0}
    labels = spark.createDataFrame([(["x", "y", "x"],), ([],), (["x", None],)], "p array<string>").select(progress.provider_label(F.col("p")).alias("l"))
    assert [r.l for r in labels.collect()] == ["x + y", "not loaded", "x"]


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, n in (("a", 3001), ("b", 2), (None, 5)) for v in rng.integers(0, 900, n)] + [("a", None), ("a", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {g: np.array([v for k, v in rows if k == g and v is not None and v == v]) for g in ("a", "b", None)}
    exact = {r.g: r for r in evaluation.exact_percentiles(df, "g", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(exact) == set(by)
    for g, v in by.items():
        assert exact[g].n == len(v) and [exact[g].p0, exact[g].p50, exact[g].p95, exact[g].p100] == pytest.approx(np.percentile(v, [0, 50, 95, 100]).tolist())
    for r in evaluation.percentiles(df, "g", "v", error=0.01).collect():
        v = by[r.g]
        for p, got in ((0.5, r.p50), (0.95, r.p95)):
            assert (v < got).sum() - 0.01 * len(v) - 1 <= p * len(v) <= (v <= got).sum() + 0.01 * len(v) + 1


def test_options_and_dictionaries(spark):
    worker.check_options(0.5, 64, 300_000, 1, 1)
    for bad in ({"min_confidence": float("nan")}, {"min_confidence": 1.1}, {"threads": 0}, {"threads": 65}, {"timeout_ms": 0}, {"timeout_ms": 300_001}, {"max_file_bytes": 0}, {"max_image_pixels": 0}):
        with pytest.raises(ValueError):
            worker.check_options(**bad)
    files = spark.createDataFrame([(m, "  character_dict:\n" + "".join(f"  - {c}\n" for c in cs)) for m, cs in (("ok", "ab"), ("count", "abc"), ("entry", ["a", "''"]))] + [("missing", "x: 1\n")], "model string, text string")
    expected = spark.createDataFrame([(m, 2) for m in ("ok", "count", "entry", "missing", "absent")], "model string, entries int")
    got = {r.model: r.status for r in images.dictionary_status(images.read_dictionary(files), expected).collect()}
    assert got == {"ok": "ok", "count": "count", "entry": "entry", "missing": "missing", "absent": "missing"}


def test_small_functions_without_a_query(spark, tmp_path):
    row = spark.range(1).select(
        language.profile_allows(F.lit("fast"), F.array(F.lit("ja"))).alias("a"), language.profile_allows(F.lit("balanced"), F.array(F.lit("ja"))).alias("b"),
        translate(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))), F.lit(3), F.lit(-1)).alias("t"),
    ).first()
    assert (row.a, row.b, [tuple(p) for p in row.t]) == (False, True, [(4.0, 1.0)])
    documents.write_json(spark.createDataFrame([(1, None), (2, "x")], "n int, s string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"n":1}', '{"n":2,"s":"x"}']
    with pytest.raises(Exception, match="already exists"):
        documents.write_json(spark.range(1), str(tmp_path / "out"))
