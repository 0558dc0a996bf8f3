"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as contamination
from . import filter_audit, harmonic, licenses, line_dedup, lm_score, ngram_join, packing, quality, sentence_dedup, site_style, toxicity, whitening
from .registry import ORACLES, QUERIES, query
from .tables import read

__all__ = ["ORACLES", "QUERIES"]


@query("op4_benchmark_decontamination", contamination.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contamination.contaminated().alias("contaminated"))


@query("op6_license_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "template_labels")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("containment")).alias("score"),
    )


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op7_quality_rules", quality.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def _with_spans(deduped: DataFrame) -> DataFrame:
    n = F.aggregate("_removed", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return deduped.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), n.alias("n_removed"), F.col("_removed").alias("removed"))


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_spans(line_dedup.dedup(read(spark, sf_dir, "documents")))


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_spans(sentence_dedup.dedup(read(spark, sf_dir, "documents")))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.trained_on()).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "hits")


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op11_filter_interaction_audit", filter_audit.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query("op13_harmonic_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack(read(spark, sf_dir, "documents"))
