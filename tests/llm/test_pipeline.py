import sys
from pathlib import Path

import brute
import pytest
from helpers import duck_rows, spark_rows

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline
from pagewright.llm import spm
from pagewright.llm.queries import QUERIES
from pagewright.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck, ORACLES[name])


def test_pipeline_equals_brute_force(spark, sf_dir, texts):
    import sentencepiece

    from pagewright.llm.spm import MODEL_PATH

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = sorted((d, t) for d, t in texts.items() if any(map(str.isalpha, t or "")))
    prints = [brute.fingerprint(t) for _, t in docs]
    comp = brute.components([d for d, _ in docs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    docs = [d for d, c in zip(docs, comp) if d[0] == c]
    bad = {r[0] for r in brute.contamination(docs, items) if r[-1]}
    docs = {d: t for d, t in docs if d not in bad}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == set(docs)
    for d, t in docs.items():
        text = sp.decode(list(rows[d].ids))
        if not sum(brute.secrets(t)[:3]):
            assert rows[d].ids == sp.encode(t)
        else:
            assert not sum(brute.secrets(text)[:3]) and ("[SECRET]" in text or "[EXAMPLE]" in text)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf_dir, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() > 0
        stage(spark, docs.limit(0), sf_dir).collect()


def test_decontamination_without_items_keeps_every_row(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "one two three", 5), (1, "one two three", 5), (None, None, 6), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows))
    assert corpus_pipeline.decontamination(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_long_ids_and_clashing_columns_pass_through(spark, tmp_path):
    rows = [
        (2**60 + 1, "A text of some words about the weather of the north", "en", "s1", 51), (None, "A letter without any id stands in the table too", None, "s2", 47),
        (2**60 + 3, "password=abcdef123 is what this other document of words holds", "en", None, 61), (5, None, "en", "s1", None), (6, "12345", "en", "s1", 5),
        (7, "the benchmark passage " * 10, "en", "s3", 220),
    ]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, shape)
    for c in ("_row", "_guess", "k1", "k2", "rid", "fp", "root", "component_id", "hits", "score", "ids", "_part"):
        docs = docs.withColumn(c, docs.source)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the benchmark passage " * 6)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {2**60 + 1, None, 2**60 + 3}
    assert "abcdef123" not in " ".join(r.text for r in spm.decode_ids(spark.createDataFrame([(got[2**60 + 3].ids,)], "ids array<int>"), out="text").collect())
