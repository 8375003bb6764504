"""Rows without a set of keys, texts staying where they are.

A set of keys becomes a bit filter of a fixed largest size, which every task may hold. Rows that miss it are not in the
set. The few keys outside the set that hit it by chance are found on narrow rows and become a second filter: a row that
hits the first but not the second is in the set for sure, and only rows that hit both are joined with the set itself. A
set too large for the filters makes more rows take that join; the result is exact at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut

#: Bits a key, and the largest number of 64-bit words of a filter (8 MB of bits, about 40 MB as a broadcast table).
BITS_A_KEY, MOST_WORDS = 32, 2**20


class KeyFilter:
    """The bit filter of a set of keys (columns k1, k2; k2 is a hash)."""

    def __init__(self, keys: DataFrame, bits: int = BITS_A_KEY, most: int = MOST_WORDS):
        n, self.words = keys.count(), 1
        while self.words * 64 < n * bits and self.words < most:
            self.words *= 2
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), self._place("k2"))
        self.table = cut(keys.groupBy(self._word("k2").alias("_word")).agg(F.bit_or(mask).alias("_bits")))

    def _word(self, k2: str) -> Column:
        return F.pmod(F.col(k2), F.lit(self.words).cast("long"))

    def _place(self, k2: str) -> Column:
        return F.shiftrightunsigned(F.col(k2), 58).cast("int")

    def mark(self, rows: DataFrame, k2: str, name: str) -> DataFrame:
        """rows with a column that is true if the key may be in the set."""
        table = self.table.withColumnsRenamed({"_word": f"{name}_word", "_bits": f"{name}_bits"})
        hit = F.coalesce(F.getbit(F.col(f"{name}_bits"), self._place(k2)) == 1, F.lit(False))
        joined = rows.join(F.broadcast(table), self._word(k2) == F.col(f"{name}_word"), "left")
        return joined.withColumn(name, hit).drop(f"{name}_word", f"{name}_bits")


def without_keys(rows: DataFrame, gone: DataFrame, present: DataFrame) -> DataFrame:
    """The rows whose (k1, k2) is not in `gone`. present: the keys of all rows, which may repeat."""
    first = KeyFilter(gone)
    chance = first.mark(present.select("k1", "k2"), "k2", "_first").filter("_first").select("k1", "k2").distinct()
    second = KeyFilter(cut(chance.join(gone, ["k1", "k2"], "left_anti")))
    marked = second.mark(first.mark(rows, "k2", "_first"), "k2", "_second")
    sure = marked.filter(~F.col("_first"))
    unsure = marked.filter(F.col("_first") & F.col("_second")).join(gone, ["k1", "k2"], "left_anti")
    return sure.select(*rows.columns).unionByName(unsure.select(*rows.columns))
