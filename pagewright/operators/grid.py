"""Pairs of boxes that overlap, by grid cells, and keys that are dealt out.

A box lies in cells whose side is the power of two that holds it: four at most. Two boxes meet in the cells of the larger
side; the smaller one is entered there too. A pair is taken in the one cell that holds the corner where its overlap starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["_page", "_level", "_cx", "_cy"]


def usable(x: str = "x", y: str = "y", width: str = "width", height: str = "height") -> Column:
    """Whether a box has finite numbers and an extent."""
    number = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))  # noqa: E731  NaN is larger
    return number(x) & number(y) & number(width) & number(height) & F.coalesce((F.col(width) > 0) & (F.col(height) > 0), F.lit(False))


def with_level(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("width", "height")))).cast("int"))


def levels_of(*tables: DataFrame) -> list[int]:
    """The sides in use, as powers of two: a few dozen at most, whatever the number of boxes."""
    found = tables[0].select("_own")
    for t in tables[1:]:
        found = found.union(t.select("_own"))
    return sorted(r[0] for r in found.distinct().collect())


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def in_cells(boxes: DataFrame, levels: list[int], page: str) -> DataFrame:
    """A row for each cell of each box (x, y, width, height, _own), at its own level and those above."""
    above = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("_own"))
    rows = boxes.withColumn("_page", F.col(page)).withColumn("_level", F.explode(above))
    span = lambda at, size: F.sequence(_cell(F.col(at), F.col("_level")), _cell(F.col(at) + F.col(size), F.col("_level")))
    return rows.withColumn("_cx", F.explode(span("x", "width"))).withColumn("_cy", F.explode(span("y", "height")))


def overlapping(left: DataFrame, right: DataFrame, levels: list[int], page: str, condition: Column | None = None) -> DataFrame:
    """Pairs of rows l and r (structs) of one page whose boxes overlap; each once. A null page is a page."""
    tables = [in_cells(t, levels, page).select(*CELL, "_own", F.struct(*t.columns).alias(n)) for t, n in ((left, "l"), (right, "r"))]
    a, b = tables[0].alias("a"), tables[1].alias("b")
    corner = lambda c: F.greatest(F.col(f"l.{c}"), F.col(f"r.{c}"))
    ends = lambda c, size: F.least(F.col(f"l.{c}") + F.col(f"l.{size}"), F.col(f"r.{c}") + F.col(f"r.{size}"))
    on = F.col("a._page").eqNullSafe(F.col("b._page"))
    for c in CELL[1:]:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    on = on & (F.greatest("a._own", "b._own") == F.col("a._level")) & (corner("x") < ends("x", "width")) & (corner("y") < ends("y", "height"))
    on = on & (_cell(corner("x"), F.col("a._level")) == F.col("a._cx")) & (_cell(corner("y"), F.col("a._level")) == F.col("a._cy"))
    return a.join(b, on if condition is None else on & condition).select("l", "r")
