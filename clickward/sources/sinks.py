"""Writers of curated rows, metric tables and stream batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clickward.session import materialize


def write_curated(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite the curated Parquet.

    With partition columns the rows are first rebalanced on them, so a
    partition value is written by few tasks, and a large one by several.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_metrics(table: DataFrame, path: str) -> None:
    """A small metric table as CSV with a header and as JSON lines, one file each.

    The table is computed once, in as many tasks as it needs, and both files
    are made from the written rows.
    """
    rows = materialize(table, "metrics").coalesce(1)
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def write_stream_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch into its own folder. A replayed batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def wait(query: StreamingQuery, timeout_seconds: int | None = None) -> None:
    """Wait for a bounded stream to finish; only with a time limit stop it and raise when it does not."""
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"Stream {query.id} did not finish in {timeout_seconds} s")
