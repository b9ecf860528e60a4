"""Registered corpus queries: each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.llm import sql
from clickward.llm.common import table
from clickward.llm.decontaminate import contaminated
from clickward.llm.html_text import page_text
from clickward.llm.licenses import license_spans
from clickward.llm.line_dedup import dedup_lines
from clickward.llm.near_dedup import near_duplicates
from clickward.llm.packing import pack_documents
from clickward.llm.quality import scored
from clickward.llm.quality_rules import judged
from clickward.llm.secrets import secret_report
from clickward.llm.spelling import spelling_groups
from clickward.llm.spot_signatures import COMMON, compared
from clickward.llm.suffix_dedup import shared_strings_removed
from clickward.llm.vector_codes import compressed

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QueryFunction = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = shared_strings_removed(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = secret_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compressed(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))


_QUERIES: list[QueryFunction] = [
    op1_line_dedup,
    op2_quality_classifier,
    op3_html_extraction,
    op4_benchmark_decontamination,
    op5_quality_rules,
    op6_best_fit_packing,
    op7_suffix_array_dedup,
    op8_license_scans,
    op9_secret_scans,
    op10_minhash_near_dedup,
    op11_vector_code_compression,
    op12_spelling_variant_grouping,
    op13_document_fingerprints,
]


def queries() -> dict[str, QueryFunction]:
    return {fn.__name__: fn for fn in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": sql.LINE_DEDUP,
        "op7_suffix_array_dedup": sql.SUFFIX_DEDUP,
        "op10_minhash_near_dedup": sql.NEAR_DEDUP,
        "op11_vector_code_compression": sql.VECTOR_CODES,
        "op12_spelling_variant_grouping": sql.SPELLING,
        "op13_document_fingerprints": sql.fingerprints(COMMON),
    }
