"""Tiles, the first boxes of a page and batches of crops by ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BOXES = 1000


def should_tile(width: Column, height: Column, tile: Column) -> Column:
    """Long images: over one and a half tiles, and twice as long as wide."""
    longer, shorter = F.greatest(width, height), F.least(width, height)
    return (longer > F.floor(tile * 3 / 2)) & (longer >= shorter * 2)


def tile_offsets(length: Column, tile: Column) -> Column:
    """Starts of tiles that overlap by an eighth of a tile or more and end with the image."""
    div = lambda a, b: F.call_function("div", a, b)
    tile, length = tile.cast("long"), length.cast("long")
    stride = F.greatest(tile - F.greatest(div(tile, F.lit(8)), F.lit(1)), F.lit(1))
    span = length - tile
    steps = div(span + stride - 1, stride)
    offsets = F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda i: div(span * i, steps))
    return F.when(length <= tile, F.array(F.lit(0).cast("long"))).otherwise(offsets)


def ratio_batches(crops: DataFrame, size: Column, page: str = "image_id") -> DataFrame:
    """crops (page, box_idx, width, height) with batch and batch_max_ratio: chunks of `size` by rising ratio."""
    ratio = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(0.0))
    rows = crops.withColumn("ratio", ratio)
    place = F.row_number().over(Window.partitionBy(page).orderBy("ratio", "box_idx"))
    rows = rows.withColumn("batch", F.floor((place - 1) / size).cast("int"))
    most = F.greatest(F.lit(1.0), F.max("ratio").over(Window.partitionBy(page, "batch")))
    return rows.withColumn("batch_max_ratio", most)


def first_boxes(boxes: DataFrame, limit: int = MAX_BOXES, page: str = "image_id") -> DataFrame:
    """The first boxes of each page by position: as many as the detector may give. Spark keeps `limit` rows a page
    before the shuffle as well as after it."""
    place = F.row_number().over(Window.partitionBy(page).orderBy("position"))
    return boxes.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")
