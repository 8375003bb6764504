import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

LONG = "Lorem ipsum dolor sit amet, password = hunter22 " * 4000
EDGE = [
    (1, "Some plain text of a few words.", "en"), (1, "Some plain text of a few words.", "en"), (2, None, "en"), (3, "", "de"), (None, "no id here", None),
    (None, None, None), (4, " \n\t ", "fr"), (5, LONG, "en"), (6, "Êtes-vous là? 漢字 ▁ 😀 \x00  ", "fr"), (7, "12345 ... !!!", "xx"), (8, LONG, None), (8, "x", "en"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s"))
    names = ("k1", "k2", "w", "g", "x", "fp", "rid", "_row", "_k1", "_k2", "_marks", "found", "repo", "owner", "bucket", "ids", "score", "lang_pred", "held_out", "word", "n_words", "hits")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
