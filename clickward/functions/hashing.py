"""Canonical text of a record and its hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The chain's start, and the root of an empty batch's hash.
GENESIS = "0" * 64
EMPTY_TEXT = "EMPTY"


def _plain(name: str, data_type: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return c.cast("decimal(38,6)").cast("string")
    return c


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Compact JSON of the columns in name order, NULLs written out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or types)
    return F.to_json(
        F.struct(*[_plain(n, types[n]).alias(n) for n in names]), {"ignoreNullFields": "false"}
    )


def record_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(canonical_json(df, columns), 256)


def canonical_record(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumn("canonical", canonical_json(df, columns))
