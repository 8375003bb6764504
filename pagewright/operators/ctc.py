"""Decoding of recogniser posteriors and boxes of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.geometry import EPSILON, area, clamp, slice_quad
from pagewright.functions.text import tokens, utrim


def best_tokens(posteriors: DataFrame, item: str = "item") -> DataFrame:
    """item, step, token, score: the largest score of each step, the last token among equals.

    posteriors: item, step, token, score.
    """
    best = posteriors.groupBy(item, "step").agg(F.max(F.struct("score", "token")).alias("b"))
    return best.select(item, "step", F.col("b.token").alias("token"), F.col("b.score").alias("score"))


def ctc_decode(steps: DataFrame, dictionary: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """item, text, confidence, columns (steps of the characters): repeats and blanks (token 0) are dropped.

    dictionary: token, entry (0 is the blank; the space is an entry too). Every item of `items` has a row; one
    without characters has the empty text and confidence 0.
    """
    before = F.lag("token", 1, -1).over(Window.partitionBy(item).orderBy("step"))
    kept = steps.withColumn("_before", before).filter((F.col("token") != 0) & (F.col("token") != F.col("_before")))
    named = kept.join(dictionary, "token").filter(F.col("entry") != "")
    entry = F.struct("step", "entry", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))
    decoded = named.groupBy(item).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.avg(entry["score"]).alias("confidence"))
    return items.join(decoded, item, "left").select(
        item,
        F.coalesce(F.array_join(F.transform("e", lambda e: e["entry"]), ""), F.lit("")).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.transform("e", lambda e: e["step"]), F.array().cast("array<int>")).alias("columns"),
    )


def character_centres(
    text: Column, columns: Column, sequence_length: Column, crop_ratio: Column, batch_max_ratio: Column, positions: Column
) -> Column:
    """Centre of each character as a share of the line's width; null if neither columns nor positions fit."""
    n = F.char_length(text)
    share = sequence_length * crop_ratio / batch_max_ratio
    by_column = F.transform(columns, lambda c: clamp((c + 0.5) / share, 0.0, 1.0))
    usable = (F.size(columns) == n) & (sequence_length > 0) & (batch_max_ratio > EPSILON)
    by_position = F.transform(positions, lambda p: clamp(p.cast("double"), 0.0, 1.0))
    return F.when(F.coalesce(usable, F.lit(False)), by_column).when(F.coalesce(F.size(positions) == n, F.lit(False)), by_position)


def word_spans(text: Column) -> Column:
    """array of (first, last): maximal runs of characters that are no white space, by index."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"))
    gaps = F.split(text, r"(?U)\S+")
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.struct(F.char_length(g).alias("gap"), F.char_length(w).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first: int, last: int>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        first = s["at"] + w["gap"]
        span = F.struct(first.alias("first"), (first + w["n"] - 1).alias("last"))
        return F.struct((first + w["n"]).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def word_boxes(quad: Column, text: Column, centres: Column) -> Column:
    """array of quads, one a word; null if there are no centres. Boundaries lie midway between characters.

    A word without area makes the number of boxes differ from that of the words: then the line has no word boxes.
    """
    count = F.size(centres)
    mid = lambda i, j: (F.get(centres, i) + F.get(centres, j)) / 2
    spans = word_spans(text)
    boxes = F.transform(
        spans,
        lambda s: slice_quad(
            quad,
            F.when(s["first"] == 0, F.lit(0.0)).otherwise(mid(s["first"] - 1, s["first"])),
            F.when(s["last"] == count - 1, F.lit(1.0)).otherwise(mid(s["last"], s["last"] + 1)),
        ),
    )
    solid = F.filter(boxes, lambda q: area(q) > EPSILON)
    fits = F.size(solid) == F.size(tokens(utrim(text)))
    return F.when(centres.isNotNull() & fits, solid)
