import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import keysets


@pytest.mark.parametrize("bits, most", [(32, 2**20), (1, 2**20), (32, 1), (32, 4)])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_rows_without_keys_at_any_fill(spark, monkeypatch, bits, most, share):
    monkeypatch.setattr(keysets.KeyFilter.__init__, "__defaults__", (bits, most))
    rng = random.Random(f"{bits} {most} {share}")
    keys = [(i, rng.getrandbits(64) - 2**63) for i in range(400)]
    lost = {k for k in keys if rng.random() < share}
    rows = [(f"text {i % 7}", *k) for i, k in enumerate(keys + keys[:50])]
    docs = spark.createDataFrame(rows, "_row string, k1 long, k2 long")
    gone = spark.createDataFrame(sorted(lost), "k1 long, k2 long")
    kept = keysets.without_keys(docs, gone, docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[1:] not in lost)


def test_only_rows_that_hit_both_filters_are_joined(spark):
    keys = spark.range(20_000).select(F.col("id").alias("k1"), F.xxhash64("id").alias("k2"))
    gone = keys.filter("k1 % 3 = 0")
    first = keysets.KeyFilter(gone)
    hit = first.mark(keys, "k2", "a").filter("a")
    assert hit.filter("k1 % 3 = 0").count() == gone.count()
    assert hit.count() < gone.count() + 0.05 * keys.count()
