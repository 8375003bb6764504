"""From detections and readings to documents: tiles, overlaps, crops, routing, selection, words, order and assembly.

The models' outputs come in as tables; everything around them is joins on image and box. Pages meet in one row only as the
document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright import dims
from pagewright.functions import geometry, language
from pagewright.functions.text import line_id, script_tag, tokens, utrim, word_id
from pagewright.operators.boxes import ratio_batches, should_tile, tile_offsets
from pagewright.operators.ctc import character_centres, word_boxes
from pagewright.operators.ordering import reading_order
from pagewright.operators.overlaps import drop_overlaps
from pagewright.operators.routing import route_crops, select_candidates
from pagewright.operators.validate import document_errors, visible_text
from pagewright.schema import ANNOTATION, COORDINATE_SYSTEMS, LINE, SCHEMA_VERSION, WORD
from pagewright.session import cut

KEYS = ("image_id", "box_idx")
_ENGINE = {"name": "pagewright", "version": "1", "backend": "tables"}


def _profile(quality: Column, column: str) -> Column:
    """A value of the quality's profile."""
    names = [c.split()[0] for c in dims.PROFILE_COLUMNS.split(", ")]
    return F.element_at(F.create_map(*[F.lit(v) for p in dims.PROFILES for v in (p[0], p[names.index(column)])]), quality)


def requested(images: DataFrame) -> DataFrame:
    """images with codes, plan (struct), refusal (null, or why the request cannot be met), tile (the detector's side) and batch."""
    codes, bad = language.resolve_languages(F.col("languages")), language.unsupported_languages(F.col("languages"))
    known = F.col("quality").isin([p[0] for p in dims.PROFILES])
    refusal = (
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown quality "), F.coalesce("quality", F.lit("null"))))
        .when(F.size(bad) > 0, F.concat(F.lit("unsupported languages "), F.array_join(bad, ", ")))
        .when(~language.profile_allows(F.col("quality"), codes), F.concat(F.lit("no "), F.col("quality"), F.lit(" profile reads ja")))
    )
    side, batch = F.when(known, _profile(F.col("quality"), "max_side")), F.when(known, _profile(F.col("quality"), "batch"))
    return images.withColumns({"codes": codes, "plan": language.recognizer_plan(codes), "refusal": refusal, "tile": side, "batch": batch})


def image_tiles(images: DataFrame) -> DataFrame:
    """image_id, tile_no, dx, dy, tiled: where each of the detector's tiles starts; one that is the image unless that is long."""
    portrait = F.col("height") >= F.col("width")
    tiled = should_tile(F.col("width"), F.col("height"), F.col("tile"))
    starts = F.when(tiled, tile_offsets(F.greatest("width", "height"), F.col("tile"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = images.select("image_id", portrait.alias("p"), tiled.alias("tiled"), F.posexplode(starts).alias("tile_no", "at"))
    return rows.select("image_id", "tile_no", F.when(~F.col("p"), F.col("at")).otherwise(0).alias("dx"), F.when(F.col("p"), F.col("at")).otherwise(0).alias("dy"), "tiled")


def placed_boxes(images: DataFrame, detections: DataFrame) -> DataFrame:
    """image_id, box_idx, points, bounds: detections (image_id, tile_no, position, points) in the image, by tile, then position.

    In tiled images a box goes that a larger kept one covers. A detection in a tile that the image lacks is left out.
    """
    box_idx = F.col("tile_no").cast("long") * 2**32 + F.col("position")
    rows = detections.join(image_tiles(images), ["image_id", "tile_no"])
    moved = geometry.translate(F.col("points"), F.col("dx"), F.col("dy"))
    rows = rows.select("image_id", box_idx.alias("box_idx"), moved.alias("points"), geometry.bounds(moved).alias("bounds"), "tiled")
    rows = cut(rows)
    many = rows.filter("tiled").select("image_id", F.col("box_idx").alias("position"), "bounds.*")
    stay = drop_overlaps(many).select("image_id", F.col("position").alias("box_idx"))
    return rows.filter("not tiled").unionByName(rows.filter("tiled").join(stay, list(KEYS), "left_semi")).drop("tiled")


def crops_of(boxes: DataFrame) -> DataFrame:
    """boxes with width and height of their crops; those without a pixel are left out."""
    quad = geometry.crop_geometry(F.col("points"))
    size = lambda c: F.when(F.size("points") >= 4, quad[c]).otherwise(F.col(f"bounds.{c}"))
    return boxes.withColumns({"width": size("width"), "height": size("height")}).filter("width >= 1 and height >= 1")


def routed(crops: DataFrame, readings: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, box_idx, recognizer, role: which recogniser sees which crop, and whether it is the primary one or a specialist.

    Of a request for Latin languages alone the Latin recogniser is the primary one.
    """
    plan = images.select("image_id", (F.size("codes") == 0).alias("auto"), "plan.*")
    first = plan.select("image_id", F.when(F.col("primary"), "primary").when(F.col("latin"), "latin").alias("recognizer")).filter("recognizer is not null")
    seen = crops.select(*KEYS).join(first, "image_id").withColumn("role", F.lit("primary"))
    read = seen.join(readings, [*KEYS, "recognizer"]).select(*KEYS, "text", "confidence")
    whole = plan.select("image_id", "auto", (F.col("primary") | F.col("latin")).alias("primary"), (F.col("latin") & F.col("primary")).alias("latin"), "cyrillic", "korean")
    special = route_crops(crops.select(*KEYS), read, whole, KEYS).select(*KEYS, F.col("specialist").alias("recognizer"), F.col("specialist").alias("role"))
    return seen.unionByName(special)


def candidates_of(crops: DataFrame, readings: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, box_idx, recognizer (its role), text, confidence, columns, sequence_length, crop_ratio, batch_max_ratio.

    Crops are batched by ratio among those that one recogniser sees of one image; blank readings are no candidates.
    """
    asked = routed(crops, readings, images).join(crops.select(*KEYS, "width", "height"), list(KEYS)).join(images.select("image_id", "batch"), "image_id")
    batched = ratio_batches(asked.withColumnRenamed("batch", "_size").withColumn("_pass", F.struct("image_id", "recognizer")), F.col("_size"), "_pass")
    known = batched.join(readings, [*KEYS, "recognizer"])
    return known.select(*KEYS, F.col("role").alias("recognizer"), "text", "confidence", "columns", "sequence_length", F.col("ratio").alias("crop_ratio"), "batch_max_ratio")


def recognized_lines(images: DataFrame, detections: DataFrame, readings: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """image_id, order, line (struct of the format): the lines of every image in reading order.

    readings: image_id, tile_no, position, recognizer, text, confidence, columns (steps of the characters), sequence_length.
    """
    readings = readings.withColumn("box_idx", F.col("tile_no").cast("long") * 2**32 + F.col("position")).filter(utrim(F.col("text")) != "")
    readings = readings.select(*KEYS, "recognizer", "text", "confidence", "columns", "sequence_length")
    crops = cut(crops_of(placed_boxes(images, detections)))
    candidates = cut(candidates_of(crops, readings, images))
    best = select_candidates(candidates, min_confidence, KEYS)
    extra = candidates.select(*KEYS, "recognizer", "columns", "sequence_length", "crop_ratio", "batch_max_ratio")
    rows = best.join(extra, [*KEYS, "recognizer"]).join(crops.select(*KEYS, "points"), list(KEYS))
    rows = rows.join(images.select("image_id", "codes", F.col("width").alias("iw"), F.col("height").alias("ih")), "image_id")
    inside = lambda points: geometry.quad_from_points(points, F.col("iw"), F.col("ih"))
    rows = rows.withColumn("quad", inside(F.col("points"))).filter("quad is not null")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).cast("float")
    rows = rows.withColumns({"number": F.row_number().over(Window.partitionBy("image_id").orderBy("box_idx")), "sure": sure, "trimmed": utrim(F.col("text"))})
    none = F.array().cast("array<double>")
    centres = character_centres(F.col("text"), F.col("columns"), F.col("sequence_length"), F.col("crop_ratio"), F.col("batch_max_ratio"), none)
    rows = rows.withColumns({"id": line_id(F.col("number")), "cells": F.when(F.size("points") >= 4, word_boxes(F.col("points"), F.col("text"), centres))})
    word = lambda w, i: F.struct(
        word_id(F.col("id"), i + 1).alias("id"), F.struct(inside(F.get("cells", i)).alias("points")).alias("quad"), w.alias("text"), F.col("sure").alias("confidence")
    )
    empty = F.array().cast(f"array<{WORD.simpleString()}>")
    words = F.coalesce(F.transform(tokens(F.col("trimmed")), word).cast(f"array<{WORD.simpleString()}>"), empty)
    rows = rows.withColumns({"words": F.when(F.col("cells").isNull(), empty).otherwise(words), "b": geometry.bounds(F.col("quad"))})
    ordered = reading_order(rows.withColumns({c: F.col(f"b.{c}") for c in ("x", "y", "width", "height")}).withColumn("position", F.col("number")))
    text = F.lit(None).cast("string")
    line = F.struct(
        F.col("id"), F.col("order").cast("long").alias("order"), F.struct(F.col("quad").alias("points")).alias("quad"), F.col("trimmed").alias("text"), text.alias("corrected_text"),
        F.col("alternatives"), F.col("sure").alias("confidence"), language.line_language(F.col("trimmed"), F.col("codes")).alias("language"), script_tag(F.col("trimmed")).alias("script"),
        F.lit("auto").alias("direction"), F.lit("clear").alias("legibility"), F.array().cast("array<string>").alias("flags"),
        F.struct(F.lit(True).alias("detection"), F.lit(True).alias("recognition")).alias("evaluation"), F.lit("model").alias("source"), F.col("words"), F.lit(False).alias("ignored"),
    )
    return ordered.select("image_id", "order", line.cast(LINE).alias("line"))


def recognize_documents(
    images: DataFrame, detections: DataFrame, readings: DataFrame, min_confidence: float = 0.8, engine: dict[str, str] | None = None, version: str = SCHEMA_VERSION
) -> DataFrame:
    """image_id, doc (the annotation, null if the request is refused), errors: one row for each image.

    images: image_id, file_name, width, height, languages (as asked for; empty: automatic), quality. detections and
    readings: see placed_boxes and recognized_lines. An image without a readable box has a document without lines.
    """
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be between 0 and 1")
    asked = cut(requested(images))
    good = asked.filter("refusal is null")
    lines = recognized_lines(good, detections, readings, min_confidence)
    pages = lines.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "line"))), lambda e: e["line"]).alias("lines"))
    rows = asked.join(pages, "image_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(f"array<{LINE.simpleString()}>")))
    none = F.lit(None).cast("string")
    made = _ENGINE | (engine or {})
    info = F.struct(*[F.lit(made[k]).alias(k) for k in _ENGINE], _profile(F.col("quality"), "recognizer").alias("model"), F.col("codes").alias("languages"), F.lit(0).cast("long").alias("elapsed_ms"))
    meta = F.struct(
        F.lit("draft").alias("status"), none.alias("annotator"), none.alias("created_at"), none.alias("updated_at"), info.alias("engine"), none.alias("notes"),
        F.lit(False).alias("sensitive"), F.array().cast("array<string>").alias("tags"), none.alias("group_id"),
    )
    image = F.struct(
        F.col("image_id").cast("string").alias("id"), F.col("file_name"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), none.alias("sha256")
    )
    doc = F.struct(
        F.lit(version).alias("schema_version"), F.lit(COORDINATE_SYSTEMS[0]).alias("coordinate_system"), image.alias("image"), visible_text(F.col("lines")).alias("text"),
        none.alias("corrected_text"), F.col("lines"), F.col("codes").alias("language_hints"), meta.alias("metadata"),
    )
    rows = rows.withColumn("doc", F.when(F.col("refusal").isNull(), doc.cast(ANNOTATION)))
    return rows.select("image_id", "doc", F.when(F.col("refusal").isNotNull(), F.array("refusal")).otherwise(document_errors(F.col("doc"), version)).alias("errors"))
