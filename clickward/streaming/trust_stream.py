"""The trust stage on a stream: each micro-batch goes through the batch operators.

Window features and duplicates look at one micro-batch only, as the stage
defines them; the drift baseline is the first non-empty micro-batch's profile.
Every write is keyed by the batch id, so a replayed micro-batch replaces its
own output, metric row and audit entry.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from clickward.operators.clean import cast_events
from clickward.operators.ordering import time_order
from clickward.plans.trust import first_baseline, trust_frames
from clickward.session import SkewPolicy, scratch_path
from clickward.sources.audit_log import append_batch
from clickward.sources.events import with_row_ids
from clickward.sources.sinks import write_metrics, write_stream_batch

METRIC_SCHEMA = "batch_id bigint, records bigint, latency_sec double, throughput_rps double, source_mode string"
REPORT = (
    "batchId long, timestamp string, numInputRows long, inputRowsPerSecond double, processedRowsPerSecond double, "
    "durationMs map<string, long>"
)


@dataclass(frozen=True)
class StreamPaths:
    """Folders of one stream, all under one root on shared storage."""

    root: str

    @property
    def output(self) -> str:
        return f"{self.root}/output"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    @property
    def baseline(self) -> str:
        return f"{self.root}/baseline"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"

    @property
    def metrics(self) -> str:
        return f"{self.root}/metrics"


def score_batch(df: DataFrame, model, features: Sequence[str] | None = None) -> DataFrame:
    """Add `pred_fraud_proba`, `pred_is_fraud` and `pred_error`.

    Gaps in the numeric features are filled as they are for a fit. A row whose
    probability is still no number has no prediction but an error text, and a
    model that does not fit the frame leaves its message on every row.
    """
    if model is None:
        return df
    from clickward.operators.models import model_inputs, positive_probability, ready_numbers
    from clickward.operators.trees import Ensemble

    nothing = {"pred_fraud_proba": F.lit(None).cast("double"), "pred_is_fraud": F.lit(None).cast("int")}
    keys = list(df.columns)
    try:
        if isinstance(model, Ensemble):
            scored = model.transform(df, "_p")
        else:
            used = list(features) if features is not None else model_inputs(model)
            # The filled copies serve the model only; the frame keeps its own values.
            held = df.withColumn("_row", F.struct(*keys))
            scored = positive_probability(model.transform(ready_numbers(held, used)), "_p").select("_row.*", "_p")
    except (AnalysisException, IllegalArgumentException) as error:
        return df.withColumns({**nothing, "pred_error": F.lit(str(error))})
    known = F.col("_p").isNotNull() & ~F.isnan("_p")
    return scored.withColumns(
        {
            "pred_fraud_proba": F.when(known, F.col("_p")),
            "pred_is_fraud": F.when(known, (F.col("_p") >= 0.5).cast("int")),
            "pred_error": F.when(~known, F.lit("probability is not a number")),
        }
    ).drop("_p")


def micro_batch(
    paths: StreamPaths,
    source_mode: str,
    model=None,
    as_of: datetime | None = None,
    audit: bool = True,
    policy: SkewPolicy | None = None,
) -> Callable[[DataFrame, int], None]:
    """The function a stream calls per micro-batch."""

    def process(batch: DataFrame, batch_id: int) -> None:
        start = time.perf_counter()
        # Several small jobs and the write read the batch; the source is read once.
        held = cast_events(with_row_ids(batch)).persist()
        try:
            records = held.count()
            if records == 0:
                return
            spark = held.sparkSession
            baseline = first_baseline(held, paths.baseline)
            scored = trust_frames(held, baseline, as_of, policy=policy).scored
            write_stream_batch(score_batch(scored, model), paths.output, batch_id)
            if audit:
                written = spark.read.parquet(f"{paths.output}/batch_id={batch_id}")
                metadata = F.to_json(
                    F.struct(F.lit(records).alias("microbatch_records"), F.lit(source_mode).alias("source_mode"))
                )
                append_batch(written, paths.audit, f"stream_{batch_id}", metadata, time_order(), policy)
            seconds = time.perf_counter() - start
            row = [(batch_id, records, seconds, records / seconds, source_mode)]
            spark.createDataFrame(row, METRIC_SCHEMA).coalesce(1).write.mode("overwrite").json(
                f"{paths.metrics}/batch={batch_id}"
            )
        finally:
            held.unpersist()

    return process


def start_stream(
    raw: DataFrame,
    paths: StreamPaths,
    source_mode: str,
    trigger_seconds: int | None = None,
    **options,
) -> StreamingQuery:
    """Start the stream: every `trigger_seconds`, or over what is there now and then end."""
    writer = raw.writeStream.foreachBatch(micro_batch(paths, source_mode, **options)).option(
        "checkpointLocation", paths.checkpoint
    )
    if trigger_seconds:
        return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()
    return writer.trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Every progress report of a query, as it arrives, in rows of a scratch folder.

    Spark itself keeps only the last hundred reports. A listener is told of each one, however many batches
    end between two looks; here only the reports of a short chunk wait in memory before they are written.
    """

    def __init__(self, query: StreamingQuery, chunk: int = 100):
        self.query, self.chunk = query, chunk
        self.done, self.newest = 0, None
        self._spark = SparkSession.active()
        self._folder = scratch_path(self._spark, "progress")
        self._held: list[str] = []
        self._last: dict[tuple, None] = {}
        self._lock, self._ended = threading.RLock(), threading.Event()
        self._spark.streams.addListener(self)
        # What was reported before the listener was there.
        for report in query.recentProgress:
            self._add(report)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == str(self.query.runId):
            self._add(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == str(self.query.runId):
            self._ended.set()

    def _add(self, report) -> None:
        key = report.batchId, report.timestamp
        with self._lock:
            if key in self._last:
                return
            self._last[key] = None
            if len(self._last) > 2 * self.chunk:
                self._last.pop(next(iter(self._last)))
            self._held.append(report.json)
            self.done += report.numInputRows > 0
            self.newest = report.batchId if self.newest is None else max(self.newest, report.batchId)
            if len(self._held) >= self.chunk:
                self.flush()

    def flush(self) -> None:
        with self._lock:
            if self._held:
                lines = self._spark.createDataFrame([(line,) for line in self._held], "value string").coalesce(1)
                lines.write.mode("append").text(self._folder)
                self._held = []

    def close(self, seconds: float = 30.0) -> None:
        """After the query has ended: wait for the last reports, then stop listening."""
        self._ended.wait(seconds)
        self._spark.streams.removeListener(self)
        for report in self.query.recentProgress:
            self._add(report)
        self.flush()

    def rows(self) -> DataFrame:
        """(value): the reports written so far, one JSON text each."""
        self.flush()
        if self.newest is None:
            return self._spark.createDataFrame([], "value string")
        return self._spark.read.text(self._folder)


def run_until(
    query: StreamingQuery, max_batches: int | None = None, poll_seconds: float = 10.0, idle_polls: int | None = None
) -> Progress:
    """Follow a stream to its end, or stop it after `max_batches` batches with
    rows or after `idle_polls` polls without a new one, where these are given."""
    seen, idle, newest = Progress(query), 0, None
    while query.isActive:
        if query.awaitTermination(poll_seconds):
            break
        idle = idle + 1 if seen.newest == newest else 0
        newest = seen.newest
        if (max_batches is not None and seen.done >= max_batches) or (idle_polls is not None and idle >= idle_polls):
            query.stop()
    seen.close()
    return seen


def run_available(raw: DataFrame, paths: StreamPaths, source_mode: str = "file", **options) -> Progress:
    """Process what the source holds now and return the progress of the ended query."""
    return run_until(start_stream(raw, paths, source_mode, **options), poll_seconds=1.0)


def stream_progress(progress: Progress, source_mode: str = "file") -> DataFrame:
    """One row per progress report: rows, rates and the parts of the batch time."""
    report = F.from_json("value", REPORT)
    spent = ("triggerExecution", "getBatch", "addBatch", "queryPlanning", "walCommit")

    def number(column: Column) -> Column:
        return F.coalesce(column, F.lit(0.0))

    parsed = progress.rows().select(report.alias("r"))
    return parsed.select(
        F.col("r.batchId").alias("batch_id"),
        F.col("r.timestamp").alias("timestamp"),
        F.coalesce("r.numInputRows", F.lit(0)).cast("long").alias("numInputRows"),
        number(F.col("r.inputRowsPerSecond")).alias("inputRowsPerSecond"),
        number(F.col("r.processedRowsPerSecond")).alias("processedRowsPerSecond"),
        *[number(F.col("r.durationMs")[k].cast("double")).alias(f"{k}_ms") for k in spent],
        F.lit(source_mode).alias("source_mode"),
    )


def run_stream(raw: DataFrame, paths: StreamPaths, source_mode: str = "file", trigger_seconds: int | None = None, max_batches: int | None = None, **options) -> DataFrame:
    """A whole stream job: run it, then write its progress, merged metrics and summary under the root.

    Metric rows are written per batch while it runs, so a driver that is lost
    loses the progress columns only. Returns the summary.
    """
    spark = raw.sparkSession
    seen = run_until(start_stream(raw, paths, source_mode, trigger_seconds, **options), max_batches, 1.0)
    progress = stream_progress(seen, source_mode)
    metrics = stream_metrics(read_metrics(spark, paths), progress)
    write_metrics(progress, f"{paths.root}/reports/progress")
    write_metrics(metrics, f"{paths.root}/reports/metrics")
    summary = stream_summary(metrics)
    write_metrics(summary, f"{paths.root}/reports/summary")
    return summary


def read_metrics(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).option("recursiveFileLookup", True).json(paths.metrics)


def stream_metrics(wall: DataFrame, progress: DataFrame) -> DataFrame:
    """Wall-clock rows with the newest progress report of the same batch."""
    keys = ["batch_id", "source_mode"]
    others = [c for c in progress.columns if c not in keys]
    newest = progress.groupBy(*keys).agg(F.max_by(F.struct(*others), "timestamp").alias("p"))
    return wall.join(newest, keys, "left").select(*wall.columns, *[F.col(f"p.{c}").alias(c) for c in others])


def stream_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count(F.lit(1)).alias("processed_batches"),
        F.avg("latency_sec").alias("average_latency_sec"),
        F.avg("throughput_rps").alias("average_throughput_rps_wall"),
        F.avg("processedRowsPerSecond").alias("average_processed_rows_per_second"),
    )


def batch_vs_stream(metrics: DataFrame, batch_records: int, batch_seconds: float) -> DataFrame:
    """Two rows: the batch run, and the mean micro-batch."""
    rate = batch_records / batch_seconds if batch_seconds > 0 else 0.0
    batch = metrics.sparkSession.createDataFrame(
        [("batch", float(rate), float(batch_seconds))], "run string, throughput_rps double, latency_sec double"
    )
    mean = metrics.agg(
        F.avg("throughput_rps").alias("throughput_rps"), F.avg("latency_sec").alias("latency_sec")
    ).select(F.lit("stream_avg").alias("run"), "throughput_rps", "latency_sec")
    return batch.unionByName(mean)
