"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.session import stored


def numbered(rows: DataFrame, group: str, order: list[str], to: str = "_nth") -> DataFrame:
    """rows with their place within the group, from 0, by `order` (nulls first; equal rows in any order).

    Rows are dealt out by ranges of group and order, which may cut a group, and written to the shared checkpoint folder; places
    within a part are shifted by the sizes of the group's parts before it. A null group is a group.
    """
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = stored(keyed.repartitionByRange(group, *order, "_row").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(group, "_part").orderBy(*order, "_row")
    near = placed.withColumn("_in", F.row_number().over(inside))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    both = near.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return both.withColumn(to, F.col("_start") + F.col("_in") - 1).drop("_row", "_part", "_in", "_group", "_of", "_start")
