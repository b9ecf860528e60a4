"""Queries of sources, sinks and sampling.

File formats are exercised by a round trip: the given table is written to the
session's scratch folder and read back through the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clickward.operators.clean import normalize_columns
from clickward.operators.rules import validation_report
from clickward.operators.sampling import stratified_sample
from clickward.plans.queries import sql
from clickward.plans.queries.registry import AS_OF, query, rounded, time_text
from clickward.plans.queries.rules import report_sql
from clickward.plans.trust import stored_baseline, trust_frames, typed_once
from clickward.session import scratch_path
from clickward.sources import events, sinks
from clickward.sources.adapters import as_raw, clicks_clean, clicks_dirty, table

RAW = ("event_id", *events.EVENT_COLUMNS)
RAW_SQL = ", ".join(RAW)
# CSV text does not tell an empty text from a missing one.
CSV_SQL = ", ".join(f"NULLIF({c}, '') AS {c}" if c == "attributed_time" else c for c in RAW)


def _csv_copy(spark, sf_dir) -> str:
    path = scratch_path(spark, "clicks-csv")
    clicks_dirty(spark, sf_dir).write.option("header", True).csv(path)
    return path


@query("src_csv_header", sql.with_(sql.DIRTY, select=f"SELECT {CSV_SQL} FROM clicks"))
def src_csv_header(spark, sf_dir):
    raw = events.read_csv_header(spark, _csv_copy(spark, sf_dir))
    return raw.select(F.col("event_id").cast("bigint").alias("event_id"), *events.EVENT_COLUMNS)


@query(
    "src_csv_schema",
    sql.with_(
        sql.DIRTY,
        select="SELECT click_time, ip, app, device, os, channel, is_fraud, is_attributed, NULLIF(attributed_time, '') AS attributed_time FROM clicks",
    ),
)
def src_csv_schema(spark, sf_dir):
    return events.read_csv_events(spark, _csv_copy(spark, sf_dir))


@query(
    "src_row_cap",
    sql.with_(
        sql.DIRTY,
        select=f"SELECT {RAW_SQL} FROM clicks ORDER BY TRY_CAST(click_time AS TIMESTAMP) ASC NULLS FIRST, event_id LIMIT 6000",
    ),
)
def src_row_cap(spark, sf_dir):
    return events.first_rows(clicks_dirty(spark, sf_dir), 6000, "click_time", "event_id").select(*RAW)


@query(
    "src_file_stream",
    sql.with_(sql.DIRTY, select=f"SELECT {CSV_SQL} FROM clicks"),
)
def src_file_stream(spark, sf_dir):
    from pyspark.sql import types as T

    schema = events.event_schema(T.StructField("event_id", T.LongType()))
    stream = events.read_file_stream(spark, _csv_copy(spark, sf_dir), files_per_trigger=4, schema=schema)
    out = scratch_path(spark, "file-stream")
    done = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "file-stream-checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    sinks.wait(done)
    return spark.read.parquet(out).select(*RAW)


@query("json_decode", sql.with_(sql.DIRTY, select=f"SELECT {RAW_SQL} FROM clicks"))
def json_decode(spark, sf_dir):
    messages = events.encode_json(clicks_dirty(spark, sf_dir), "value", "event_id")
    return events.decode_json(messages.withColumn("value", F.col("value").cast("binary")), "value", "event_id")


@query(
    "json_encode",
    sql.with_(
        sql.DIRTY,
        select="SELECT event_id, CAST(to_json({"
        + ", ".join(f"{c}: {c}" for c in events.EVENT_COLUMNS)
        + "}) AS VARCHAR) AS value FROM clicks",
    ),
)
def json_encode(spark, sf_dir):
    return events.encode_json(clicks_dirty(spark, sf_dir), "value", "event_id")


@query(
    "sink_curated_parquet",
    sql.with_(
        *sql.DIRTY_FLAGS,
        sql.score(),
        select="SELECT event_id, ip, app, device, os, channel, is_fraud, click_day, round(veracity_score, 6) AS veracity_score FROM scored WHERE is_valid_record",
    ),
)
def sink_curated_parquet(spark, sf_dir):
    path = scratch_path(spark, "curated")
    sinks.write_curated(trust_frames(typed_once(clicks_dirty(spark, sf_dir)), as_of=AS_OF).curated, path, partition_by=("click_day",))
    return spark.read.parquet(path).select(
        "event_id", "ip", "app", "device", "os", "channel", "is_fraud", "click_day", *rounded("veracity_score")
    )


@query("sink_metrics", sql.with_(*sql.DIRTY_FLAGS, select=report_sql()))
def sink_metrics(spark, sf_dir):
    """The report as its CSV file gives it back."""
    path = scratch_path(spark, "metrics")
    report = validation_report(trust_frames(typed_once(clicks_dirty(spark, sf_dir)), as_of=AS_OF).flags)
    sinks.write_metrics(report, path)
    back = spark.read.option("header", True).schema(report.schema).csv(f"{path}/csv")
    return back.select("rule", "total_records", "duplicates_removed", "invalid_count", *rounded("invalid_percent"), "unknown_count")


@query(
    "normalize_columns",
    sql.with_(
        sql.CLEAN,
        select="SELECT event_id, click_time, ip, app, device, os, channel, CAST(1 - CAST(is_attributed AS INTEGER) AS VARCHAR) AS is_fraud, is_attributed, '' AS attributed_time FROM clicks",
    ),
)
def normalize(spark, sf_dir):
    foreign = (
        clicks_clean(spark, sf_dir)
        .withColumnRenamed("click_time", "Event_Time")
        .drop("is_fraud", "attributed_time")
    )
    return normalize_columns(foreign, keep=("event_id",))


@query(
    "stratified_sample",
    sql.with_(
        sql.CLEAN,
        sql.TYPED,
        select="""
SELECT event_id, is_fraud FROM (
  SELECT event_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42:' || event_id), event_id) AS place,
    greatest(1, round_even(count(*) OVER (PARTITION BY is_fraud) * (3000 / CAST(count(*) OVER () AS DOUBLE)), 0)) AS quota
  FROM typed)
WHERE place <= quota
""",
    ),
)
def stratified(spark, sf_dir):
    from clickward.operators.clean import cast_events

    typed = cast_events(clicks_clean(spark, sf_dir))
    return stratified_sample(typed, 3000, "is_fraud", 42).select("event_id", "is_fraud")


@query("provenance_manifest")
def provenance_manifest(spark, sf_dir):
    manifest = events.file_manifest(spark, f"{sf_dir}/events.parquet")
    return events.with_column_schema(manifest, table(spark, sf_dir, "events"))


@query(
    "baseline_snapshot",
    sql.with_(
        sql.CLEAN,
        sql.TYPED,
        sql.shares("typed"),
        sql.baseline(),
        select="SELECT feature, value, round(share, 6) AS share FROM baseline",
    ),
)
def baseline_snapshot(spark, sf_dir):
    from clickward.operators.clean import cast_events

    store = scratch_path(spark, "baseline-store")
    typed = cast_events(clicks_clean(spark, sf_dir))
    source = f"{sf_dir}/events.parquet"
    stored_baseline(typed, store, source, row_cap=0)
    again = stored_baseline(typed, store, source, row_cap=0)
    return again.select("feature", "value", *rounded("share"))
