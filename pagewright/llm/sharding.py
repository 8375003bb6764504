"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Every row gets a number 0..N-1 in the order (bucket of id and checksum, id, checksum, size). A keyed Feistel network over
a mixed-radix domain a*b >= N, walked until it lands below N, maps that number to a position; position modulo the
shard count is the shard and the quotient the slot. Shard sizes differ by one row at most, and the place of any
row number can be computed without the data.

Numbering needs no global sort: rows are dealt into a fixed number of buckets by arithmetic, rows are numbered
within each bucket and the (bounded) table of bucket sizes gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PRIME = 2**31 - 1
MULTIPLIER = 48271
BUCKETS = 4096
RUN = 10_000
ROUND_KEYS = ((16807, 11), (69621, 23), (39373, 37), (40692, 53), (40014, 71), (45991, 97))
MAX_WALK = 64


def bucket_of(doc_id: Column, checksum: Column, buckets: int = BUCKETS) -> Column:
    """By id and checksum, so that neither null ids nor an id of many rows fill one bucket."""
    mixed = (F.pmod(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(PRIME)) * MULTIPLIER) % PRIME
    return F.pmod(mixed + checksum, F.lit(buckets)).cast("int")


def _quotient(x: Column, y: Column | int) -> Column:
    """x div y in whole numbers."""
    return F.call_function("div", x, F.lit(y) if isinstance(y, int) else y)


def feistel(x: Column, a: Column, b: Column, seed: int = 0) -> Column:
    """One pass of the network: a bijection of 0..a*b-1.

    Each round swaps the halves and adds a quadratic residue of the one to the other, modulo the other's range; an
    even number of rounds puts the ranges back in place.
    """
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(c + seed).alias("c")) for m, c in ROUND_KEYS])
    start = F.struct(_quotient(x, b).alias("u"), (x % b).alias("v"), a.alias("ru"), b.alias("rv"))

    def turn(s: Column, key: Column) -> Column:
        t = (s["v"] % PRIME * key["m"] + key["c"]) % PRIME
        return F.struct(
            s["v"].alias("u"),
            ((s["u"] + (t * t + key["c"]) % PRIME) % s["ru"]).alias("v"),
            s["rv"].alias("ru"),
            s["ru"].alias("rv"),
        )

    return F.aggregate(keys, start, turn, lambda s: s["u"] * s["rv"] + s["v"])


def permute(x: Column, n: Column, a: Column, b: Column, seed: int = 0) -> Column:
    """Cycle walking: apply the network until the value is below n.

    a*b exceeds n by less than a, so a second step is needed for about one row in sqrt(n). A walk visits at most
    a*b-n values outside; MAX_WALK steps cover that for n up to 4096, and beyond it a longer walk has a chance
    under 64**-64. Should one occur, the query raises an error instead of returning a wrong place.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)),
        feistel(x, a, b, seed),
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)),
        lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")),
    )


def number_rows(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds row_number (0..N-1) and total. rows: has bucket and the columns of order, which alone are kept.

    Repeated rows are counted before they are dealt out, RUN input rows at a time, so that a row with many copies is
    a short list of counts in its bucket until the numbers are given, and no list of copies is longer than RUN.
    """
    run = _quotient(F.monotonically_increasing_id(), RUN).alias("run")  # equal rows may change places
    counted = rows.select("*", run).groupBy("bucket", *order, "run").agg(F.count(F.lit(1)).alias("copies"))
    within = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order], "run").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("before", F.sum("copies").over(within) - F.col("copies"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(  # one row a bucket: BUCKETS rows at most
        "bucket",
        F.coalesce(F.sum("rows").over(running), F.lit(0)).alias("offset"),
        F.sum("rows").over(whole.partitionBy(F.lit(0))).alias("total"),
    )
    return (
        placed.join(F.broadcast(offsets), "bucket")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
        .withColumn("row_number", F.col("offset") + F.col("before") + F.col("copy"))
        .select(*order, "row_number", "total")
    )


def feistel_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    num_shards: int = 16,
    seed: int = 0,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Null text: size 1 and checksum 0, as for empty text. Null ids sort first. Repeated rows get places of their
    own. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    checksum = F.crc32(text.cast("binary"))
    rows = docs.select(
        bucket_of(F.col(id_col), checksum).alias("bucket"),
        F.col(id_col).alias("doc_id"),
        checksum.alias("text_crc32"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
    )
    numbered = number_rows(rows, ["doc_id", "text_crc32", "size"])
    b = F.ceil(F.sqrt(F.col("total").cast("double"))).cast("long")
    sides = numbered.withColumn("b", b).withColumn("a", _quotient(F.col("total") + F.col("b") - 1, F.col("b")))
    at = sides.withColumn("at", permute(F.col("row_number"), F.col("total"), F.col("a"), F.col("b"), seed))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("at") % num_shards).cast("int").alias("shard"),
        _quotient(F.col("at"), num_shards).alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
