"""One query per operator, with production parameters over its whole table,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.llm import oracles, pii_spans
from specgrade.llm.collocations import collocations
from specgrade.llm.common import read
from specgrade.llm.decontaminate import contaminated
from specgrade.llm.exact_dedup import exact_dedup
from specgrade.llm.license_scan import license_scan
from specgrade.llm.line_crf import quality
from specgrade.llm.line_dedup import line_dedup
from specgrade.llm.mixture_packing import mixture
from specgrade.llm.ngram_jaccard import ngram_components
from specgrade.llm.packing import pack
from specgrade.llm.token_alignment import alignment
from specgrade.llm.token_counts import token_counts
from specgrade.llm.url_filter import url_filter


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9)).withColumn("containment", F.round("containment", 9))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii_spans.pii_spans(docs, pii_spans.learn(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_crf, op3_token_counts, op4_decontaminate, op5_exact_dedup, op6_pii_spans,
                                   op7_line_dedup, op8_ngram_jaccard, op9_best_fit_packing, op10_url_filter, op11_collocations,
                                   op12_mixture_packing, op13_token_alignment)}
ORACLE = {
    "op1_license_scan": oracles.LICENSE_SCAN,
    "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op7_line_dedup": oracles.LINE_DEDUP,
    "op11_collocations": oracles.COLLOCATIONS,
}
