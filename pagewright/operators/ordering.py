"""Reading order of lines and the text of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.text import utrim

ROW_TOLERANCE = 0.5


def reading_order(lines: DataFrame, page: str = "image_id") -> DataFrame:
    """lines (page, x, y, width, height, position) with `row` and the new `order`.

    Lines follow each other by y, then x. A line stays in the row of the one before it if their centres differ by
    at most half of the lower height; rows are then read from left to right. Ties keep the input position.
    """
    down = Window.partitionBy(page).orderBy("y", "x", "position")
    centre = F.col("y") + F.col("height") / 2
    gap = F.abs(centre - F.lag(centre).over(down))
    near = gap <= ROW_TOLERANCE * F.least(F.col("height"), F.lag("height").over(down))
    broken = lines.withColumn("_break", F.when(near, 0).otherwise(1))
    rows = broken.withColumn("row", F.sum("_break").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(page).orderBy("row", "x", "y", "position")
    return rows.withColumn("order", F.row_number().over(across) - 1).drop("_break")


def rebuild_text(lines: DataFrame, page: str = "image_id") -> DataFrame:
    """One row a page: text of the visible lines in order, and corrected_text, null if it is the same.

    lines: page, order, position, text, corrected_text, ignored. Ignored and blank lines are left out.
    """
    shown = utrim(F.col("text")), utrim(F.coalesce("corrected_text", "text"))
    visible = ~F.coalesce(F.col("ignored"), F.lit(False))

    def joined(column, keep):
        entry = F.when(visible & (keep != ""), F.struct("order", "position", column.alias("t")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "\n")

    text, fixed = joined(shown[0], shown[0]), joined(shown[1], shown[1])
    pages = lines.groupBy(page).agg(text.alias("text"), fixed.alias("_fixed"))
    return pages.select(page, "text", F.nullif("_fixed", "text").alias("corrected_text"))


def readable_lines(lines: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """The lines with text and enough confidence; the text is trimmed. A null or NaN confidence is not enough."""
    sure = (F.col("confidence") >= min_confidence) & ~F.isnan("confidence")
    return lines.withColumn("text", utrim(F.col("text"))).filter(sure & (F.col("text") != ""))
