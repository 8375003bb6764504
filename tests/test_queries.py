import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import duck_rows, spark_rows
from pyspark.sql import functions as F

from pagewright.plans.catalog import QUERIES
from pagewright.plans.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck, ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def _equals_sql_on_pages(spark, folder, name, pages):
    import duckdb

    docs = spark.range(50 * max(pages) + 50).filter(F.floor(F.col("id") / 50).isin(pages)).selectExpr("id as doc_id", "concat('w', id) as text")
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert spark_rows(QUERIES[name](spark, str(folder))) == duck_rows(con, ORACLES[name])


def test_polygon_matches_at_the_least_overlap_and_half_digits(spark, tmp_path):
    _equals_sql_on_pages(spark, tmp_path, "polygon_matches", [32, 49, 65, 107, 134, 148, 190])


def test_end_to_end_scores_where_half_is_excused(spark, tmp_path):
    """Predictions of which an unreadable region covers just half still count."""
    _equals_sql_on_pages(spark, tmp_path, "end_to_end_scores", [71, 161, 187])


def test_heatmap_regions_of_blocks(spark, sf_dir):
    rows = QUERIES["heatmap_regions"](spark, sf_dir).collect()
    assert rows and all(r.width > 240 and r.height > 80 and r.score > 0.9 for r in rows)


def test_heatmaps_of_one_file_are_dealt_out(spark, sf_dir):
    assert QUERIES["heatmap_regions"](spark, sf_dir).rdd.getNumPartitions() > 1


def test_errors_count_code_points_of_any_script(spark, tmp_path):
    texts = ["é è 漢字", "è é 漢子", "à\u3000b\u2003c", "à b d", "Привет мир", "Привет мир", "😀 x", "", "ж"]
    rows = [(1, i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    chars = {r.turn: (r.edits, r.reference_units, r.exact_match) for r in QUERIES["character_errors"](spark, str(tmp_path)).collect()}
    words = {r.turn: (r.edits, r.reference_units) for r in QUERIES["word_errors"](spark, str(tmp_path)).collect()}
    pairs = dict(enumerate(zip(texts, texts[1:])))
    assert chars == {i: (edits(a, b), len(a), a == b) for i, (a, b) in pairs.items()}
    assert words == {i: (edits(a.split(), b.split()), len(a.split())) for i, (a, b) in pairs.items()}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["image_id", "line_id", "row", "line_order"]
