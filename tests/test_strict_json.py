"""Texts that are not one JSON object, and documents of many lines."""

import json
import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators import validate
from pagewright.schema import ANNOTATION
from pagewright.sources import documents

GOOD = ['{"a":1}', ' {"a":[1,{"x":null}],"b":{"a":1}} \n', '{"a":"\\ud83d\\ude00 \\\\ud800"}', '{}', '{"a":"}],[{ x"}']
BAD = {
    "text after the JSON object": ['{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', '{"a":1}},{"c":{"b":1}', '{"a":1}\x00', '{"a":1}#c', '{"a":1},'],
    "a member is repeated": ['{"a":1,"a":1}', '{"a":{"b":1,"b":2}}', '{"a":[1,[{"b":1,"c":2,"b":3}]]}'],
    "not a JSON object": ["{'a':1}", '{"a":NaN}', '{"a":-Infinity}', '{"a":01}', '{"a":1,}', "{a:1}", '{"a":"\t"}', '{"a":.5}', '{"a":"\\x"}', "", "[1]", "5", '{"a":1', '{"a":1,"a":1} x', "﻿{}", None],
    "half of a surrogate pair": ['{"a":"\\ud800"}', '{"a":"\\udc00 \\ud83d\\ude00"}'],
}


def test_texts(spark):
    rows = [(t, None) for t in GOOD] + [(t, e) for e, ts in BAD.items() for t in ts]
    got = spark.createDataFrame(rows, "json string, want string").select("json", "want", documents.text_error(F.col("json")).alias("error")).collect()
    assert [(r.json, r.error) for r in got] == [(r.json, r.want) for r in got]


def page(n):
    point = lambda x, y: {"x": x, "y": y}
    line = lambda i: {
        "id": f"l{i % (n - 3)}", "order": i if i % 1000 else 0, "quad": {"points": [point(0, 0), point(5, 0), point(5, 5), point(0, 5)]}, "text": "x", "direction": "auto", "legibility": "clear",
        "evaluation": {"detection": True, "recognition": True}, "source": "model", "words": [{"id": f"w{i}", "quad": {"points": [point(0, 0), point(5, 0), point(5, 5), point(0, 5)]}, "text": "x"}], "ignored": False,
    }
    return json.dumps(
        {
            "schema_version": "annotation.v1", "coordinate_system": "pixel_top_left", "image": {"id": "i", "file_name": "f", "width": 20, "height": 20}, "text": "", "lines": [line(i) for i in range(n)],
            "language_hints": ["en"], "metadata": {"status": "draft", "tags": [f"t{i % 40000}" for i in range(50000)]},
        }
    )


def test_a_document_of_many_lines(spark):
    """Rules of unique ids, orders and tags do not grow with the square of their number."""
    n = 50_000
    df = spark.createDataFrame([(page(n),)], "json string").withColumn("doc", F.from_json("json", ANNOTATION))
    df = df.select("doc").checkpoint() if spark.sparkContext.getCheckpointDir() else df.select("doc").cache()
    df.count()
    start = time.time()
    errors = df.select(validate.document_errors(F.col("doc")).alias("e")).first().e
    took = time.time() - start
    assert len([e for e in errors if e.startswith("id l") and e.endswith("is duplicated")]) == 3
    assert len([e for e in errors if ".order 0 is duplicated" in e]) == 49 and len([e for e in errors if e.startswith("metadata.tags") and e.endswith("duplicated")]) == 10000
    assert errors[-1] != errors[0] and took < 60
    df.unpersist()


@pytest.mark.parametrize("values, want", [(["a", "b", "a", "", None, "a", " "], ["p[2] is duplicated", "p[3] must not be empty", "p[4] must not be empty", "p[5] is duplicated", "p[6] must not be empty"]), ([], []), (None, []), (["x"], [])])
def test_unique_texts(spark, values, want):
    df = spark.createDataFrame([(values,)], "v array<string>")
    assert df.select(validate.unique_texts(F.col("v"), "p").alias("e")).first().e == want
