"""Registry of named queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.session import allow_local_scratch

QueryFunction = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFunction] = {}
_SQL: dict[str, str] = {}

MODULES = (
    "ingest",
    "clean",
    "features",
    "rules",
    "splits",
    "encoding",
    "evaluate",
    "audit",
    "stream",
    "models",
)

# The clock of the range rule in all registered queries.
AS_OF = datetime(2024, 2, 1)


def query(name: str, sql: str | None = None):
    def register(fn: QueryFunction) -> QueryFunction:
        if name in _QUERIES:
            raise ValueError(f"Query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            allow_local_scratch(spark)
            return fn(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for module in MODULES:
        if importlib.util.find_spec(f"clickward.plans.queries.{module}") is None:
            continue
        importlib.import_module(f"clickward.plans.queries.{module}")


def queries() -> dict[str, QueryFunction]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def time_text(name: str) -> Column:
    """A timestamp as text, so that no session zone enters a comparison."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]
