"""Columns and batch work that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take Spark's fast lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that name a row by its content.

    Rows with equal keys have equal ids and texts, hence equal results. The pair spreads rows evenly
    if many ids are null as well as if many texts are equal.
    """
    return [
        F.coalesce(doc_id.cast("long"), F.lit(-(2**63) + 1)).alias("k1"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("k2"),
    ]


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def hot_values(counts: DataFrame, key: str, n: str = "n", share: int = 1000) -> list:
    """The values of `key` that hold at least one in `share` of all rows, by a table of each value's count `n`: at most
    `share` values, whatever the table's size."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.filter(F.col(n) * share >= F.lit(total)).select(key).collect()]


def spread_join(rows: DataFrame, one_each: DataFrame, key: str, by: list[str], parts: int = 32, hot: list | None = None) -> DataFrame:
    """rows joined with a table of one row a key, or a few. A key's rows are dealt over `parts` by a hash of `by`, and what the other table has for it
    is repeated as often, so that no key lands in one task. With `hot` (see hot_values) only these keys are dealt out. The
    repeated rows are never broadcast, whatever size Spark takes them to have before they are repeated."""
    dealt = F.lit(True) if hot is None else F.col(key).isin(hot)
    places = F.when(dealt, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    many = one_each.withColumn("_part", F.explode(places)).hint("merge")
    part = F.when(dealt, F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    return rows.withColumn("_part", part).join(many, [key, "_part"]).drop("_part")


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
#: Arrow types of the columns that batch work makes, by their Spark names.
ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<struct<start: int, end: int, kind: string>>": pa.list_(_SPAN),
}
#: Code points of texts that are worked on at once: a bound of memory, not of results.
CHUNK_CHARS = 1_500_000


def slices(batch: pa.RecordBatch, text: str, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about `chars` code points of text each, at least one row a run."""
    column = batch.column(text)
    length = pc.binary_length if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pc.utf8_length
    sizes = pc.fill_null(length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > chars:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield batch.slice(start)


def map_rows(
    rows: DataFrame, uses: list[str], new: dict[str, str], start: Callable[[], Callable[..., dict]], chars: int = CHUNK_CHARS
) -> DataFrame:
    """rows without the columns `uses`, with the columns `new` (name to type) that start()(*lists) gives.

    start() runs once a task; what it returns is called with the values of `uses`, the first of which is the text
    whose length bounds a call (about `chars` code points). All other columns pass as Arrow data, so that long ids stay exact beside nulls.
    """
    kept = [f for f in rows.schema.fields if f.name not in uses]
    names = [f.name for f in kept] + list(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, uses[0], chars):
                made = work(*[part.column(c).to_pylist() for c in uses])
                columns = [part.column(f.name) for f in kept] + [pa.array(made[c], ARROW[t]) for c, t in new.items()]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = [T.StructField(c, T.DataType.fromDDL(t)) for c, t in new.items()]
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in kept] + made))
