"""Greedy batches of crops by rising width, for pages of any size.

The packing is sequential, but since widths rise, all that a crop needs to know of those before it is how many are in the
open batch: less than a batch holds. Each block of a page's crops is run for every such number at once; the runs of blocks
are then linked in one pass over a row a block, and the blocks are numbered from where they really start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.places import numbered

BLOCK = 4096
#: A batch of two or more is closed by a crop wider than this, or than its widest times the factor.
WIDE, FACTOR = 256.0, 1.85


def _closes(widths: np.ndarray, before: float, size: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each crop: how many a batch may hold with it, and whether it is much wider than the one before."""
    last = np.concatenate([[before], widths[:-1]])
    room = np.minimum(size, np.where(widths > 0, budget // np.maximum(widths, 1), size))
    return room, widths > np.maximum(WIDE, FACTOR * last)


def _run(widths: np.ndarray, before: float, counts: np.ndarray, size: int, budget: int, trace: bool = False) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Counts in the open batch after the block and batches closed in it, for each count before it."""
    closed, numbers = np.zeros_like(counts), []
    for room, odd in zip(*_closes(widths, before, size, budget)):
        close = (counts > 0) & ((counts + 1 > room) | ((counts >= 2) & odd))
        closed = closed + close
        counts = np.where(close, 1, counts + 1)
        if trace:
            numbers.append(int(closed[0]))
    return counts, closed, numbers


def width_batches(crops: DataFrame, size: int, budget: int, page: str = "image_id") -> DataFrame:
    """page, box_idx, width, batch: greedy packing of crops (page, box_idx, width) by rising width, ties by box_idx.

    A batch is closed when one more crop would exceed its count or its padded width, or is much wider than the rest.
    A null page is a page; a null width counts as 0, null widths and ids first.
    """
    kind = crops.schema[page].dataType
    rows = crops.select(page, F.col("box_idx").cast("long").alias("box_idx"), F.coalesce(F.col("width").cast("long"), F.lit(0).cast("long")).alias("width"))
    rows = numbered(rows, page, ["width", "box_idx"]).withColumn("_block", F.floor(F.col("_nth") / BLOCK).cast("long"))
    rows = rows.withColumn("_context", F.lit(False))
    border = rows.filter(F.col("_nth") % BLOCK == BLOCK - 1).withColumns({"_block": F.col("_block") + 1, "_context": F.lit(True)})
    rows = rows.unionByName(border)
    key = T.StructField(page, kind)
    start = T.StructType([key, *T.StructType.fromDDL("_block long, counts array<long>, closed array<long>")])
    linked = T.StructType([key, *T.StructType.fromDDL("_block long, count long, batch long")])
    out = T.StructType([key, *T.StructType.fromDDL("box_idx long, width long, batch int")])

    def widths_of(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, float]:
        part = part.sort_values("_nth")
        before = part.loc[part["_context"], "width"]
        own = part[~part["_context"]]
        return own, own["width"].to_numpy(), float(before.iloc[0]) if len(before) else 0.0

    def runs(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own, widths, before = widths_of(part)
        counts, closed, _ = _run(widths, before, np.arange(size + 1), size, budget)
        return pd.DataFrame([(k[0], k[1], counts.tolist(), closed.tolist())], columns=start.names) if len(own) else pd.DataFrame([], columns=start.names)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, batch = object(), 0, 0
        for rows in batches:
            found = []
            for p, b, counts, closed in rows[start.names].itertuples(index=False, name=None):
                if b == 0:
                    now, count, batch = p, 0, 0
                found.append((p, b, count, batch))
                count, batch = int(counts[count]), batch + int(closed[count])
            yield pd.DataFrame(found, columns=linked.names)

    def number(k: tuple, part: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        own, widths, before = widths_of(part)
        if not len(own):
            return pd.DataFrame([], columns=out.names)
        _, _, numbers = _run(widths, before, np.array([at["count"].iloc[0]]), size, budget, trace=True)
        return pd.DataFrame({page: own[page], "box_idx": own["box_idx"], "width": own["width"], "batch": int(at["batch"].iloc[0]) + np.array(numbers)})

    blocks = rows.groupBy(page, "_block").applyInPandas(runs, start)
    starts = blocks.repartition(page).sortWithinPartitions(page, "_block").mapInPandas(link, linked)
    return rows.groupBy(page, "_block").cogroup(starts.groupBy(page, "_block")).applyInPandas(number, out)
