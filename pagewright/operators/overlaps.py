"""Removal of boxes that larger ones cover, in rounds over grid cells and over pairs; no page is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import EPSILON, overlap_over_smaller
from pagewright.operators.grid import CELL, in_cells, levels_of, overlapping, usable, with_level
from pagewright.session import cut

OVERLAP = 0.65
#: Pairs that the cells may hold for each box before the boxes on top of their cells are settled first.
DENSE = 200
#: Parts over which the boxes of a cell are dealt when they meet the box on top of it.
PARTS = 16


def _ranked(boxes: DataFrame) -> DataFrame:
    """Boxes with their rank: from the largest on, ties in input order."""
    return boxes.withColumn("rank", F.struct((-F.col("width") * F.col("height")).alias("minus"), "position", "x", "y", "width", "height", "_id"))


def _settle_tops(active: DataFrame, cells: DataFrame, overlap: float) -> tuple[DataFrame, DataFrame]:
    """Boxes left to decide, and those found covered, after one round.

    A box on top (by rank) of each cell that it lies in overlaps no larger one: it stays, and what it covers goes.
    """
    top = cells.groupBy(*CELL).agg(F.min("rank").alias("rank"))
    spread = cells.groupBy("rank._id").agg(F.count(F.lit(1)).alias("lies_in"))
    on_top = top.groupBy("rank._id").agg(F.count(F.lit(1)).alias("tops"))
    winners = cut(spread.join(on_top, "_id").filter("tops = lies_in").select("_id"))
    theirs = top.withColumn("_id", F.col("rank._id")).join(winners, "_id", "left_semi").select(*CELL, F.col("rank").alias("top"))
    dealt = theirs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = cells.withColumn("_part", F.pmod(F.xxhash64("rank._id"), F.lit(PARTS)).cast("int")).alias("c")
    on = F.col("c._page").eqNullSafe(F.col("t._page"))
    for c in [*CELL[1:], "_part"]:
        on = on & (F.col(f"c.{c}") == F.col(f"t.{c}"))
    met = rows.join(dealt.alias("t"), on & (F.col("c.rank") > F.col("t.top")))
    gone = cut(met.filter(overlap_over_smaller(F.col("t.top"), F.col("c.rank")) >= overlap).select(F.col("c.rank._id").alias("_id")).distinct())
    return cut(active.join(winners.unionByName(gone), "_id", "left_anti")), gone


def _load(cells: DataFrame, n: int) -> bool:
    """Whether the cells hold too many pairs: those that a cell's own boxes form with all in it."""
    own = F.count_if(F.col("_own") == F.col("_level")).cast("double")
    pairs = cells.groupBy(*CELL).agg((own * F.count(F.lit(1))).alias("p")).agg(F.sum("p")).first()[0]
    return (pairs or 0) > DENSE * n


def drop_overlaps(boxes: DataFrame, page: str = "image_id", overlap: float = OVERLAP) -> DataFrame:
    """Boxes (page, position, x, y, width, height) that survive: from the largest on, a box goes if a kept one
    covers the given share (over 0) of the smaller of the two. Ties in area keep the input order.

    Equal boxes are settled first, then boxes on top of their cells while a cell holds many, then the pairs that cover each other:
    each round keeps every box that no undecided larger one covers and drops what those cover. A null page is
    a page; boxes without finite numbers or area cover nothing and stay; repeated rows count as copies.
    """
    if overlap <= 0:
        raise ValueError("overlap must be over 0")
    rows = cut(boxes.select(page, "position", "x", "y", "width", "height").withColumn("_id", F.monotonically_increasing_id()))
    solid = usable() & (F.col("width") * F.col("height") > EPSILON)
    spot = [page, "x", "y", "width", "height"]
    live = rows.filter(solid)
    if overlap <= 1:
        first = live.groupBy(*spot).agg(F.min(F.struct("position", "_id")).alias("first"))
        live = first.select(*spot, "first.*")
    active = cut(with_level(live))
    kept, gone, levels, n = active.select("_id"), None, levels_of(active), active.count()
    while n:
        cells = in_cells(_ranked(active), levels, page).select(*CELL, "_own", "rank")
        if not _load(cells, n):
            break
        active, covered = _settle_tops(active, cut(cells), overlap)
        gone = covered if gone is None else cut(gone.unionByName(covered))
        n = active.count()
    if n:
        ranked = _ranked(active)
        larger = F.col("l.rank") < F.col("r.rank")
        pairs = overlapping(ranked, ranked, levels, page, larger).filter(overlap_over_smaller(F.col("l"), F.col("r")) >= overlap)
        edges = cut(pairs.select(F.col("l._id").alias("high"), F.col("r._id").alias("low")))
        while not edges.isEmpty():
            held = edges.select(F.col("low").alias("high")).distinct()
            covered = cut(edges.join(held, "high", "left_anti").select(F.col("low").alias("_id")).distinct())
            gone = covered if gone is None else cut(gone.unionByName(covered))
            left = edges.join(covered.withColumnRenamed("_id", "low"), "low", "left_anti")
            edges = cut(left.join(covered.withColumnRenamed("_id", "high"), "high", "left_anti"))
    if gone is not None:
        kept = kept.join(gone, "_id", "left_anti")
    staying = kept.unionByName(rows.filter(~F.coalesce(solid, F.lit(False))).select("_id"))
    return rows.join(staying, "_id", "left_semi").drop("_id")
