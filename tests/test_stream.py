"""The stream gives what the batch operators give per micro-batch, also after a restart."""

from __future__ import annotations

from datetime import datetime

import pytest
from paths import SMALL_DIR
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickward.operators.clean import cast_events
from clickward.operators.profile import baseline_stats
from clickward.plans.trust import trust_frames
from clickward.session import scratch_path
from clickward.sources import audit_log, events
from clickward.sources.adapters import clicks_clean
from clickward.streaming import trust_stream as job

AS_OF = datetime(2024, 2, 1)
SCHEMA = events.event_schema(T.StructField("event_id", T.LongType()))


@pytest.fixture(scope="module")
def run(spark):
    """Two files streamed, the stream ended, one more file streamed from the same checkpoint."""
    source = scratch_path(spark, "source")
    paths = job.StreamPaths(scratch_path(spark, "stream"))
    clicks = clicks_clean(spark, SMALL_DIR)

    def add(part):
        rows = clicks.where(F.col("event_id") % 3 == part)
        rows.coalesce(1).write.mode("append").option("header", True).csv(source)

    def stream():
        return job.run_available(events.read_file_stream(spark, source, 1, SCHEMA), paths, as_of=AS_OF)

    add(0)
    add(1)
    first = stream()
    add(2)
    second = stream()
    return paths, first, second


def test_equals_batch(spark, run):
    paths, _, _ = run
    got = spark.read.parquet(paths.output)
    clicks = clicks_clean(spark, SMALL_DIR)
    parts = [cast_events(clicks.where(F.col("event_id") % 3 == p)) for p in range(3)]
    baseline = baseline_stats(parts[0])
    for batch_id, part in enumerate(parts):
        # CSV does not tell an empty text from a missing one.
        want = trust_frames(part, baseline, AS_OF).scored.drop("attributed_time")
        mine = got.where(F.col("batch_id") == batch_id).select(*want.columns)
        assert mine.count() == part.count() > 0
        assert mine.exceptAll(want).count() == 0


def test_audit_and_metrics(spark, run):
    paths, first, second = run
    assert tuple(audit_log.verify_log(spark, paths.audit).first()) == (True, 3, None, None)
    wall = job.read_metrics(spark, paths)
    assert {r["batch_id"] for r in wall.collect()} == {0, 1, 2}
    assert wall.agg(F.sum("records")).first()[0] == clicks_clean(spark, SMALL_DIR).count()
    progress = job.stream_progress(first).unionByName(job.stream_progress(second))
    merged = job.stream_metrics(wall, progress)
    assert merged.count() == 3
    assert merged.where("numInputRows <> records").count() == 0
    summary = job.stream_summary(merged).first()
    assert summary["processed_batches"] == 3 and summary["average_latency_sec"] > 0
    both = job.batch_vs_stream(merged, 1000, 2.0).collect()
    assert [r["run"] for r in both] == ["batch", "stream_avg"] and both[0]["throughput_rps"] == 500.0


def test_replayed_batch_changes_nothing(spark, run):
    paths, _, _ = run
    before = spark.read.parquet(paths.output).count()
    # A replay brings the very same rows; the CSV source gave an empty text as missing.
    seen = F.when(F.col("attributed_time") != "", F.col("attributed_time"))
    again = clicks_clean(spark, SMALL_DIR).where(F.col("event_id") % 3 == 2).withColumn("attributed_time", seen)
    job.micro_batch(paths, "file", as_of=AS_OF)(again, 2)
    assert spark.read.parquet(paths.output).count() == before
    assert tuple(audit_log.verify_log(spark, paths.audit).first()) == (True, 3, None, None)


def test_empty_batch_leaves_no_trace(spark):
    paths = job.StreamPaths(scratch_path(spark, "stream"))
    job.micro_batch(paths, "file")(clicks_clean(spark, SMALL_DIR).where("false"), 0)
    assert audit_log.read_lines(spark, paths.audit).count() == 0


def test_run_until_stops(spark):
    source = scratch_path(spark, "source")
    clicks_clean(spark, SMALL_DIR).repartition(4).write.option("header", True).csv(source)
    paths = job.StreamPaths(scratch_path(spark, "stream"))
    stream = events.read_file_stream(spark, source, 1, SCHEMA)
    query = job.start_stream(stream, paths, "file", trigger_seconds=1, audit=False)
    job.run_until(query, max_batches=2, poll_seconds=1)
    assert not query.isActive
    assert spark.read.parquet(paths.output).select("batch_id").distinct().count() >= 1


def test_misfit_model_leaves_its_message(spark):
    class Misfit:
        def transform(self, df):
            return df.select("no_such_column")

    scored = job.score_batch(spark.range(3), Misfit())
    assert scored.where("pred_error like '%no_such_column%'").count() == 3


def test_no_report_is_lost_between_two_polls(spark):
    """More batches than Spark keeps reports of, and chunks that are written on the way."""
    source = scratch_path(spark, "many")
    spark.range(0, 115, 1, 115).write.csv(source)
    files = len([1 for _ in spark.read.format("binaryFile").load(source).select("path").collect()])
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).csv(source)
    writer = stream.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "checkpoint"))
    seen = job.run_until(writer.trigger(availableNow=True).start(), poll_seconds=600)
    rows = job.stream_progress(seen).where("numInputRows > 0").collect()
    assert files > 100 and sorted(r["batch_id"] for r in rows) == list(range(files))
    assert sum(r["numInputRows"] for r in rows) == 115 and all(r["triggerExecution_ms"] > 0 for r in rows)


def test_a_part_of_the_source_is_written_by_many_tasks(spark, monkeypatch):
    """One micro-batch per part, of many files, with the rows that one file per part gives."""
    from clickward.plans.queries import stream as queries

    clicks = clicks_clean(spark, SMALL_DIR)
    parts = {r["part"]: r["count"] for r in clicks.groupBy((F.col("event_id") % 3).alias("part")).count().collect()}
    monkeypatch.setattr(queries, "FILE_ROWS", min(parts.values()) // 4)
    source = scratch_path(spark, "source")
    files = queries._write_parts(spark, SMALL_DIR, source)
    read = events.read_file_stream(spark, source, files, SCHEMA)
    written = spark.read.schema(SCHEMA).option("header", True).csv(source)
    counted = written.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("event_id") % 3).alias("part")).collect()
    assert files == 4 and read.isStreaming
    assert sorted(r["part"] for r in counted) == [0] * 4 + [1] * 4 + [2] * 4
    assert max(r["n"] for r in counted) < 2 * min(r["n"] for r in counted)
    done, paths = queries._run(spark, SMALL_DIR, audit=False)
    got = spark.read.parquet(paths.output)
    assert {(r["part"], r["batch_id"]): r["count"] for r in got.groupBy((F.col("event_id") % 3).alias("part"), "batch_id").count().collect()} == {
        (part, part): n for part, n in parts.items()
    }
