import os

import pytest
from pyspark.sql import functions as F

from pagewright.sources import sinks


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, None, None), (2, None, None)], "n int, s string, v array<double>")
    with pytest.raises(sinks.SinkError, match="nothing is published"):
        sinks.read_published(spark, path)
    assert sinks.publish(rows, path)["rows"] == 3
    assert sorted(map(tuple, sinks.read_published(spark, path).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(sinks.SinkError, match="already"):
        sinks.publish(rows, path)
    with pytest.raises(sinks.SinkError, match="input"):
        sinks.publish(sinks.read_published(spark, path).filter("n = 1"), path, overwrite=True)
    with pytest.raises(Exception, match="killed"):  # a write that ends half-way
        sinks.publish(rows.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("n"))), path, overwrite=True)
    assert sinks.read_published(spark, path).count() == 3
    sinks.publish(rows.limit(0), path, kind="json", overwrite=True)
    assert sinks.read_published(spark, path).columns == ["n", "s", "v"] and sinks.read_published(spark, path).count() == 0
    left = sinks.remove_unpublished(spark, path)
    assert all(n.startswith("data-") for n in left) and len([n for n in os.listdir(path) if n.startswith("data-")]) == 1


def test_a_write_that_does_not_verify(spark, tmp_path):
    """CSV cannot tell an empty text from null: what is read back differs, and nothing is published."""
    rows = spark.createDataFrame([("",), (None,)], "s string").coalesce(1)
    with pytest.raises(sinks.SinkError, match="read back"):
        sinks.publish(rows.withColumn("t", F.lit(" \n")), str(tmp_path / "out"), kind="csv")
    assert sinks.published(spark, str(tmp_path / "out")) is None
