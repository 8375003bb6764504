"""Writes that are seen whole or not at all: data aside, counted and checked, then one manifest that names it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


class SinkError(ValueError):
    """A write that was refused or did not verify."""


def _sum(columns: list[str]) -> list[Column]:
    """Rows, and a checksum of them that does not depend on their order."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("checksum")]


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path within it, as the cluster's configuration has them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def _place(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place by a rename, over an older one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, at = _hadoop(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, at, options)


def _reads(df: DataFrame, path: str) -> bool:
    """Whether a table is read from files in a folder."""
    _, target = _hadoop(df.sparkSession, path)
    inside = target.toUri().getPath().rstrip("/") + "/"
    return any(_hadoop(df.sparkSession, f)[1].toUri().getPath().startswith(inside) for f in df.inputFiles())


def published(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a folder; None if nothing is published there."""
    fs, at = _hadoop(spark, f"{path}/{MANIFEST}")
    return json.loads(spark.read.text(at.toString(), wholetext=True).first()[0]) if fs.exists(at) else None


def publish(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False) -> dict:
    """Write a table below a folder and publish it; returns the manifest.

    Rows and checksum are taken while they are written and again from what was written; if they differ, nothing is published. Until
    the manifest is renamed into place readers see the version before, if any, so that a write that is killed at any moment
    leaves nothing to see. A folder that the table itself is read from is refused, also when it may be overwritten.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    if _reads(df, path):
        raise SinkError("the target is an input of the table")
    if not overwrite and published(spark, path) is not None:
        raise SinkError("the target is published already")
    seen, data = Observation(), f"{path}/data-{run}"
    df.observe(seen, *_sum(df.columns)).write.mode("errorifexists").format(kind).save(data)
    wrote, schema = seen.get, df.schema
    back = spark.read.schema(schema).format(kind).load(data).agg(*_sum(df.columns)).first().asDict()
    if wrote != back:
        raise SinkError(f"written rows and checksum {wrote} are read back as {back}")
    manifest = {"run": run, "format": kind, "schema": json.loads(schema.json()), **back}
    _place(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
    return manifest


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a folder."""
    from pyspark.sql.types import StructType

    manifest = published(spark, path)
    if manifest is None:
        raise SinkError("nothing is published here")
    return spark.read.schema(StructType.fromJson(manifest["schema"])).format(manifest["format"]).load(f"{path}/data-{manifest['run']}")


def remove_unpublished(spark: SparkSession, path: str) -> list[str]:
    """Delete what killed or replaced writes have left; returns the names. Not while a write is under way."""
    fs, at = _hadoop(spark, path)
    now = f"data-{(published(spark, path) or {}).get('run')}"
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in (now, MANIFEST) and s.getPath().getName().startswith(("data-", f".{MANIFEST}-"))]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)
