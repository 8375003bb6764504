"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.sharding import feistel_shards

    return feistel_shards(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.embedding_dedup import dedup_vectors

    return dedup_vectors(table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.decontam import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.simhash import simhash_report

    return simhash_report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.langid import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.spm import spm_report

    return spm_report(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


#: Host, path and verdict of the query's rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.url_filter import RULE, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULE))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_html_extraction": op7_html_extraction,
    "op8_pii": op8_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_url_filter": op13_url_filter,
}
