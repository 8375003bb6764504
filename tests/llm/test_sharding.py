import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pagewright.llm import sharding


def check(rows, n, shards=16):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == n
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_network_is_a_bijection(spark):
    for n in (1, 2, 3, 5, 10, 97, 1000, 4096):
        b = int(n**0.5) + (int(n**0.5) ** 2 < n)
        a = -(-n // b)
        one = F.lit
        at = sharding.permute(F.col("id"), one(n).cast("long"), one(a).cast("long"), one(b).cast("long"))
        got = sorted(r.at for r in spark.range(n).select(at.alias("at")).collect())
        assert got == list(range(n))


def test_places_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, sharding.feistel_shards(docs).collect()), key=repr)
    assert one == sorted(map(tuple, sharding.feistel_shards(docs.repartition(13)).collect()), key=repr)
    check(sharding.feistel_shards(docs).collect(), docs.count())
    assert {r.text_crc32 for r in sharding.feistel_shards(docs).collect()} == {zlib.crc32((r.text or "").encode()) for r in docs.collect()}
    other = sharding.feistel_shards(docs, seed=9)
    assert sorted(map(tuple, other.collect()), key=repr) != one


def test_edge_rows(edge, none):
    rows = sharding.feistel_shards(edge).collect()
    check(rows, edge.count())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)}
    assert sharding.feistel_shards(none).collect() == []


def test_a_hot_id_keeps_its_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    check(sharding.feistel_shards(df).collect(), 3000)
    assert Counter(r.doc_id for r in sharding.feistel_shards(df).collect())[7] == 1500


def test_null_ids_and_one_id_spread_over_buckets(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") < 50_000, F.lit(None)).otherwise(5).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    buckets = rows.groupBy(sharding.bucket_of(F.col("doc_id"), F.crc32(F.col("text").cast("binary"))).alias("b")).count()
    assert buckets.agg(F.max("count")).first()[0] < 100 and buckets.count() == sharding.BUCKETS


def test_runs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    check(sharding.feistel_shards(spark.createDataFrame([(None, "same")] * 500 + [(1, None)] * 40, "doc_id long, text string")).collect(), 540)
