"""The registered queries of this subpackage: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import group_matrix_join, html_layout, language_nb, license_rules, maxent_lm, pfair_mix, pivot_permutation, quality_gbt, sentence_spans, sentencepiece_unigram
from .common import read_table


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(read_table(spark, sf_dir, "documents"))


def op2_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = language_nb.held_out()
    model = language_nb.train(docs.where(~out))
    return language_nb.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.license_scan(read_table(spark, sf_dir, "documents")).drop("spans")


def op5_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.render_pages(read_table(spark, sf_dir, "pages"))


def op6_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_unigram.load()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_unigram.decode(sentencepiece_unigram.encode(docs, model), model)
    return rows.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        sentencepiece_unigram.digest().alias("ids_digest"),
        F.get("ids", F.lit(0)).alias("first_id"),
        F.expr("get(ids, size(ids) - 1)").alias("last_id"),
        F.expr("decoded <=> text").alias("round_trip"),
    )


def op7_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_permutation.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pfair_mix.mix(docs).drop("text")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.cut_repeats(docs, report=True)


def op10_group_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_matrix_join.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_quality_gbt": op2_quality_gbt,
    "op3_language_nb": op3_language_nb,
    "op4_license_rules": op4_license_rules,
    "op5_html_layout": op5_html_layout,
    "op6_sentencepiece_unigram": op6_sentencepiece_unigram,
    "op7_pivot_permutation": op7_pivot_permutation,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_group_matrix_join": op10_group_matrix_join,
}
ORACLE_SQL: dict[str, str] = {
    "op7_pivot_permutation": pivot_permutation.ORACLE,
    "op10_group_matrix_join": group_matrix_join.ORACLE,
}
