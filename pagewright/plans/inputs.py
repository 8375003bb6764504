"""Inputs of the registered queries, derived from the tables by arithmetic that any SQL engine repeats.

A page holds fifty documents; each is one recognised line with a box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL that both Spark and DuckDB understand.
LINES = """
select cast(floor(doc_id / 50.0) as bigint) as image_id, doc_id as line_id, doc_id as position, text,
       cast((doc_id * 7919) % 1000 as double) as x, cast((doc_id * 104729) % 600 as double) as y,
       cast(40 + (doc_id * 31) % 200 as double) as width, cast(10 + doc_id % 13 as double) as height,
       cast((doc_id * 37) % 101 as double) / 100 as confidence, doc_id % 11 = 0 as ignored,
       case when doc_id % 7 = 0 then concat(text, '!') end as corrected_text
from documents
"""

TEXTS = ["Hello", "Нello", "Привет", "한국어 2026", "本地文字", "ひらがな漢字", "strong", "слабый", "×", "12.5", "Ærø", ""]
#: Candidates: four recognisers read each document's box.
CANDIDATES = """
select cast(floor(doc_id / 50.0) as bigint) as image_id, doc_id as box_idx, recognizer, word as text,
       cast((doc_id * 13 + k * 29) % 45 + 56 as double) / 100 as confidence
from documents join recognizers on doc_id % 5 <> k join words on n = (doc_id + k * 5) % 12
"""
RECOGNIZERS = "select * from (values (0, 'primary'), (1, 'latin'), (2, 'cyrillic'), (3, 'korean')) as r(k, recognizer)"
WORDS = "select * from (values {}) as w(n, word)".format(", ".join(f"({i}, '{t}')" for i, t in enumerate(TEXTS)))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(LINES.replace("from documents", "from {documents}"), documents=docs)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sql = CANDIDATES.replace("from documents", "from {documents}").replace("join recognizers", "join {recognizers}").replace("join words", "join {words}")
    return spark.sql(sql, documents=docs, recognizers=F.broadcast(spark.sql(RECOGNIZERS)), words=F.broadcast(spark.sql(WORDS)))


def tsv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, tsv: each document's words as the output of an external recogniser, ten words a line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    row = lambda w, i: F.concat_ws(
        "\t", F.lit("5"), F.lit("1"), F.call_function("div", i, F.lit(100)).cast("string"), F.lit("1"),
        F.call_function("div", i, F.lit(10)).cast("string"), (i % 10).cast("string"), ((i % 10) * 60).cast("string"),
        (F.call_function("div", i, F.lit(10)) * 20).cast("string"), (F.char_length(w) * 8).cast("string"), F.lit("16"),
        ((i * 37 + F.col("doc_id")) % 101).cast("string"), w,
    )
    page = F.concat_ws("\t", F.lit("1"), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("640"), F.lit("4000"), F.lit("-1"), F.lit(""))
    body = F.transform(words, row)
    return docs.select(F.col("doc_id").alias("image_id"), F.array_join(F.concat(F.array(F.lit("header"), page), body), "\n").alias("tsv"))


#: Every second image is three tiles long; a fifth of its boxes lie where two tiles overlap and are found in both.
IMAGES = """
select distinct cast(floor(doc_id / 50.0) as bigint) as image_id, concat(cast(floor(doc_id / 50.0) as bigint), '.png') as file_name, 1200 as width,
       case when cast(floor(doc_id / 50.0) as bigint) % 2 = 0 then 3000 else 700 end as height from documents
"""
DETECTIONS = """
select image_id, position, case when image_id % 2 = 0 then position % 3 else 0 end as tile_no, x, width, height,
       case when image_id % 2 = 0 and position % 5 = 0 then 860 + cast(y as bigint) % 380 else y end as y from lines
"""
TWICE = """
select image_id, position, tile_no, x, y, width, height from seen
union all select image_id, position, tile_no + 1 as tile_no, x, y - 860 as y, width, height from seen where image_id % 2 = 0 and position % 5 = 0 and tile_no < 2
"""


def recognition(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images with requests, detections by tile, and readings of four recognisers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = lambda *w: F.array(*[F.lit(v) for v in w]).cast("array<string>")
    request = F.when(F.col("image_id") % 7 == 6, words("xx", "de"))
    for k, codes in enumerate((("auto",), ("de",), ("ru", "en"), ("ko",))):
        request = request.when(F.col("image_id") % 4 == k, words(*codes))
    images = spark.sql(IMAGES.replace("from documents", "from {documents}"), documents=docs).withColumns({"languages": request, "quality": F.lit("balanced")})
    seen = spark.sql(DETECTIONS.replace("from lines", "from {lines}"), lines=lines(spark, sf_dir))
    twice = spark.sql(TWICE.replace("from seen", "from {seen}"), seen=seen)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, right, low = F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")
    detections = twice.select("image_id", F.col("tile_no").cast("int"), "position", F.array(corner(x, y), corner(right, y), corner(right, low), corner(x, low)).alias("points"))
    read = candidates(spark, sf_dir).withColumnRenamed("box_idx", "position")
    n = F.char_length("text")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    readings = detections.select("image_id", "tile_no", "position").join(read, ["image_id", "position"])
    return images, detections, readings.withColumns({"columns": steps, "sequence_length": n + 2})
