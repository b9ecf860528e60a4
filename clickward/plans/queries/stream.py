"""Queries of the streaming job. The stream reads CSV files made from the given
table, equally many files per micro-batch, and ends when all are processed."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickward.operators.audit import parse_lines
from clickward.operators.clean import cast_events
from clickward.operators.ordering import number_order
from clickward.operators.rules import RULES
from clickward.plans.queries import sql
from clickward.plans.queries.audit import CHAIN
from clickward.plans.queries.registry import AS_OF, query, rounded
from clickward.plans.trust import trust_frames, typed_once
from clickward.session import scratch_path
from clickward.sources import audit_log, events, sinks
from clickward.sources.adapters import as_clicks, clicks_clean, table
from clickward.streaming import trust_stream as job

PARTS = 3
# Rows of one source file; a micro-batch reads as many files as its part was cut into.
FILE_ROWS = 100_000
SCHEMA = events.event_schema(T.StructField("event_id", T.LongType()))


def _write_parts(spark, sf_dir, source) -> int:
    """Write three parts one after another, so that their order is fixed, each as the same number of files; return that number."""
    rows = table(spark, sf_dir, "events")
    part_of = F.col("event_id") % PARTS
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part_of.alias("part")).count().collect()}  # three rows
    # Rows go round the files, so none is empty: a file would be missing then, and the next part would move up.
    files = max(1, min(sizes.get(part, 0) for part in range(PARTS)) // FILE_ROWS)
    for part in range(PARTS):
        mine = rows.where(part_of == part)
        mine = mine.coalesce(1) if files == 1 else mine.repartition(files)
        as_clicks(mine).write.mode("append").option("header", True).csv(source)
    return files


def _run(spark, sf_dir, **options):
    """Write the parts and stream them, one per micro-batch."""
    source = scratch_path(spark, "stream-source")
    files = _write_parts(spark, sf_dir, source)
    paths = job.StreamPaths(scratch_path(spark, "stream"))
    stream = events.read_file_stream(spark, source, files_per_trigger=files, schema=SCHEMA)
    return job.run_available(stream, paths, as_of=AS_OF, **options), paths


# The batch SQL with every window and profile kept inside one part.
_PART = f"event_id % {PARTS}"
_TYPED = sql.TYPED.replace("SELECT event_id,", f"SELECT event_id, CAST({_PART} AS INTEGER) AS part,", 1)
_FEATURES = (
    sql.FEATURES.replace("PARTITION BY ip", "PARTITION BY part, ip")
    .replace("SELECT ip, count(*)", "SELECT part, ip, count(*)")
    .replace("FROM typed GROUP BY ip)", "FROM typed GROUP BY part, ip)")
    .replace("SELECT app, channel, count(*) AS app_channel_freq FROM typed GROUP BY app, channel", "SELECT part, app, channel, count(*) AS app_channel_freq FROM typed GROUP BY part, app, channel")
    .replace("ON w.ip = i.ip", "ON w.ip = i.ip AND w.part = i.part")
    .replace("AND w.channel = c.channel", "AND w.channel = c.channel AND w.part = c.part")
)
_BOUNDS = sql.BOUNDS.replace("SELECT q1, q3,", "SELECT part, q1, q3,").replace(
    "SELECT quantile_cont", "SELECT part, quantile_cont", 1
).replace("FROM feats))", "FROM feats GROUP BY part))")
_FLAGS = (
    sql.FLAGS.replace("FROM bounds)", "FROM bounds b WHERE b.part = feats.part)")
    .replace("PARTITION BY ip, app", "PARTITION BY part, ip, app")
)
_STREAM = (
    sql.CLEAN,
    _TYPED,
    _FEATURES,
    "first_part AS (SELECT * FROM typed WHERE part = 0)",
    sql.shares("first_part"),
    sql.baseline(),
    _BOUNDS,
    _FLAGS,
    sql.score(),
)


@query(
    "stream_trust",
    sql.with_(
        *_STREAM,
        select=f"SELECT event_id, part AS batch_id, clicks_per_ip, inter_click_seconds, {', '.join(RULES)}, is_valid_record, round(veracity_score, 6) AS veracity_score FROM scored",
    ),
)
def stream_trust(spark, sf_dir):
    _, paths = _run(spark, sf_dir, audit=False)
    return spark.read.parquet(paths.output).select(
        "event_id", "batch_id", "clicks_per_ip", "inter_click_seconds", *RULES, "is_valid_record", *rounded("veracity_score")
    )


@query(
    "stream_baseline",
    sql.with_(
        sql.CLEAN,
        _TYPED,
        "first_part AS (SELECT * FROM typed WHERE part = 0)",
        sql.shares("first_part"),
        sql.baseline(),
        select="SELECT feature, value, round(share, 6) AS share FROM baseline",
    ),
)
def stream_baseline(spark, sf_dir):
    _, paths = _run(spark, sf_dir, audit=False)
    return spark.read.parquet(paths.baseline).select("feature", "value", *rounded("share"))


@query(
    "sink_stream_parquet",
    sql.with_(
        sql.CLEAN,
        _TYPED,
        select="SELECT event_id, part AS batch_id, ip, app, device, os, channel, is_fraud FROM typed",
    ),
)
def sink_stream_parquet(spark, sf_dir):
    """Every batch is written twice, as after a restart, and counts once."""
    path = scratch_path(spark, "stream-batches")
    typed = cast_events(clicks_clean(spark, sf_dir))
    for part in [*range(PARTS), *range(PARTS)]:
        sinks.write_stream_batch(typed.where(F.col("event_id") % PARTS == part), path, part)
    return spark.read.parquet(path).select("event_id", "batch_id", "ip", "app", "device", "os", "channel", "is_fraud")


_LABELLED = f"""
leaves AS (
  SELECT 'attributed_' || is_attributed AS batch_id,
    row_number() OVER (PARTITION BY is_attributed ORDER BY event_id) - 1 AS pos, sha256({sql.CANONICAL}) AS record_hash
  FROM clicks)
"""
_LABEL_HEADERS = """
headers AS (
  SELECT row_number() OVER (ORDER BY batch_id) - 1 AS seq, batch_id, record_count, merkle_root,
    '{"stage":"by_label"}' AS batch_metadata
  FROM roots)
"""
ENTRY = ("seq", "batch_id", "record_count", "merkle_root", "batch_metadata", "prev_batch_hash", "batch_hash")


@query(
    "sink_audit_jsonl",
    sql.with_(sql.CLEAN, _LABELLED, sql.merkle(), _LABEL_HEADERS, CHAIN, select=f"SELECT {', '.join(ENTRY)} FROM chain"),
)
def sink_audit_jsonl(spark, sf_dir):
    """The lines of a log after one appended batch per label."""
    path = scratch_path(spark, "audit-log")
    clicks = clicks_clean(spark, sf_dir)
    for flag in ("0", "1"):
        audit_log.append_batch(
            clicks.where(F.col("is_attributed") == flag),
            path,
            f"attributed_{flag}",
            F.lit('{"stage":"by_label"}'),
            number_order("event_id"),
        )
    return parse_lines(audit_log.read_lines(spark, path)).select(*ENTRY)


_PER_PART = sql.with_(sql.CLEAN, f"parts AS (SELECT event_id % {PARTS} AS part, count(*) AS n FROM clicks GROUP BY 1)", select="{}")


@query(
    "stream_audit",
    _PER_PART.format("SELECT part AS seq, 'stream_' || part AS batch_id, n AS record_count, true AS verified FROM parts"),
)
def stream_audit(spark, sf_dir):
    """The entries of the streamed log, and whether the log holds together."""
    _, paths = _run(spark, sf_dir)
    good = audit_log.verify_log(spark, paths.audit).first()["success"]
    entries = parse_lines(audit_log.read_lines(spark, paths.audit))
    return entries.select("seq", "batch_id", "record_count", F.lit(good).alias("verified"))


@query(
    "stream_progress",
    _PER_PART.format("SELECT part AS batch_id, n AS \"numInputRows\", 'file' AS source_mode, true AS timed FROM parts"),
)
def stream_progress(spark, sf_dir):
    """Rows per batch as reported; the times themselves differ from run to run."""
    done, _ = _run(spark, sf_dir, audit=False)
    reports = job.stream_progress(done).where(F.col("numInputRows") > 0)
    return reports.select("batch_id", "numInputRows", "source_mode", (F.col("triggerExecution_ms") > 0).alias("timed"))


def _metrics(spark, sf_dir):
    done, paths = _run(spark, sf_dir, audit=False)
    return job.stream_metrics(job.read_metrics(spark, paths), job.stream_progress(done))


@query(
    "stream_metrics",
    _PER_PART.format("SELECT part AS batch_id, n AS records, n AS \"numInputRows\", 'file' AS source_mode, true AS timed FROM parts"),
)
def stream_metrics(spark, sf_dir):
    timed = (F.col("latency_sec") > 0) & (F.col("throughput_rps") > 0) & (F.col("processedRowsPerSecond") > 0)
    return _metrics(spark, sf_dir).select("batch_id", "records", "numInputRows", "source_mode", timed.alias("timed"))


@query(
    "stream_summary",
    _PER_PART.format("SELECT count(*) AS processed_batches, bool_and(n > 0) AS timed FROM parts"),
)
def stream_summary(spark, sf_dir):
    means = [F.col(c) > 0 for c in ("average_latency_sec", "average_throughput_rps_wall", "average_processed_rows_per_second")]
    return job.stream_summary(_metrics(spark, sf_dir)).select("processed_batches", (means[0] & means[1] & means[2]).alias("timed"))


@query("batch_vs_stream")
def batch_vs_stream(spark, sf_dir):
    start = time.perf_counter()
    path = scratch_path(spark, "batch-run")
    frames = trust_frames(typed_once(clicks_clean(spark, sf_dir)), as_of=AS_OF)
    frames.scored.write.parquet(path)
    seconds = time.perf_counter() - start
    return job.batch_vs_stream(_metrics(spark, sf_dir), spark.read.parquet(path).count(), seconds)
