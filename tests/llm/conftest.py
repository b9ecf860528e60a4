from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture()
def documents(spark):
    """Build a documents table from (doc_id, text); further columns clash with names used inside."""

    def make(rows):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.select(
            "doc_id",
            "text",
            F.lit(None).cast("string").alias("lang"),
            F.lit("s").alias("source"),
            F.lit(0).cast("long").alias("n_chars"),
            F.lit(1).alias("id"),
            F.lit(2).alias("key"),
            F.lit(3).alias("root"),
            F.lit("x").alias("score"),
            F.lit("x").alias("block"),
        )

    return make
