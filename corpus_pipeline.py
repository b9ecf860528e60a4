"""A training corpus from `documents`: filtered, deduplicated, decontaminated and packed.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before
kept, and all but the last return the columns of `documents`. `run` writes
each result as Parquet to the shared folder and reads it again, so a lost
executor costs tasks of one stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.llm.common import table
from clickward.llm.decontaminate import without_leaks
from clickward.llm.line_dedup import dedup_lines
from clickward.llm.near_dedup import near_duplicates
from clickward.llm.packing import pack_documents
from clickward.llm.quality import good_documents
from clickward.llm.queries import TOKENIZER
from clickward.session import allow_local_scratch, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good."""
    return good_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    text = F.col("kept_text")
    return dedup_lines(docs, also=["lang", "source"]).select(
        "doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars")
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    copies = materialize(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096."""
    return pack_documents(docs, TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(fn: Stage) -> Stage:
    """A local session without a shared folder, as in tests, may use one of this machine."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        allow_local_scratch(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _stage(quality)),
    ("line_dedup", _stage(lines)),
    ("minhash_near_dedup", _stage(near_copies)),
    ("benchmark_decontamination", _stage(decontaminated)),
    ("best_fit_packing", _stage(packed)),
]

# Learnt weights and token ids are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow_local_scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
