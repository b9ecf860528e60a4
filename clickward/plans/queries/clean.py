"""Queries of casts, filters and column selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickward.operators import clean as ops
from clickward.plans.queries import sql
from clickward.plans.queries.registry import query, rounded, time_text
from clickward.plans.trust import trust_frames, typed_once
from clickward.sources.adapters import clicks_clean, clicks_dirty

TYPED_COLUMNS = ("ip", "app", "device", "os", "channel", "is_fraud", "is_attributed")


@query(
    "cast_events",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        select=f"SELECT event_id, {sql.time_text('click_time_ts', 'click_time_ts')}, {sql.time_text('attributed_time_ts', 'attributed_time_ts')}, {', '.join(TYPED_COLUMNS)} FROM typed",
    ),
)
def cast_events(spark, sf_dir):
    return ops.cast_events(clicks_dirty(spark, sf_dir)).select(
        "event_id", time_text("click_time_ts"), time_text("attributed_time_ts"), *TYPED_COLUMNS
    )


@query("derive_is_fraud", sql.with_(sql.DIRTY, sql.TYPED, select="SELECT event_id, is_fraud, is_attributed FROM typed"))
def derive_is_fraud(spark, sf_dir):
    return ops.cast_events(clicks_dirty(spark, sf_dir)).select("event_id", "is_fraud", "is_attributed")


@query(
    "time_parts",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        sql.FEATURES,
        select=f"SELECT event_id, click_hour, click_day, click_weekday, click_minute, {sql.time_text('event_hour', 'event_hour')} FROM parts",
    ),
)
def time_parts(spark, sf_dir):
    return ops.time_parts(ops.cast_events(clicks_dirty(spark, sf_dir))).select(
        "event_id", "click_hour", "click_day", "click_weekday", "click_minute", time_text("event_hour")
    )


@query(
    "prepare_events",
    sql.with_(sql.DIRTY, sql.TYPED, sql.PREPARED, select="SELECT event_id, day, hour, minute, second FROM prepared"),
)
def prepare_events(spark, sf_dir):
    return ops.prepare_events(ops.cast_events(clicks_dirty(spark, sf_dir))).select(
        "event_id", "day", "hour", "minute", "second"
    )


@query(
    "click_unix",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        select="SELECT event_id, COALESCE(epoch_us(click_time_ts) // 1000000, 0) AS click_unix FROM typed",
    ),
)
def click_unix(spark, sf_dir):
    return ops.click_unix(ops.cast_events(clicks_dirty(spark, sf_dir))).select("event_id", "click_unix")


@query(
    "clean_target",
    sql.with_(
        sql.DIRTY,
        select="SELECT event_id, COALESCE(TRY_CAST(is_attributed AS INTEGER), 0) AS is_attributed FROM clicks",
    ),
)
def clean_target(spark, sf_dir):
    return ops.clean_target(clicks_dirty(spark, sf_dir), "is_attributed").select("event_id", "is_attributed")


@query(
    "safe_feature_select",
    sql.with_(
        sql.CLEAN,
        sql.TYPED,
        sql.FEATURES,
        select="SELECT event_id, ip, app, device, os, channel, click_hour, click_day, click_weekday, click_minute, clicks_per_ip, clicks_per_ip_per_hour, unique_channels_per_ip, app_channel_freq, inter_click_seconds FROM feats",
    ),
)
def safe_feature_select(spark, sf_dir):
    from clickward.operators.features import trust_features

    features = trust_features(ops.cast_events(clicks_clean(spark, sf_dir)))
    kept = ops.safe_feature_select(features, "is_attributed", keep=("event_id",))
    return kept.drop("click_time_ts", "event_hour", "prev_click_time")


@query(
    "curate",
    sql.with_(
        *sql.DIRTY_FLAGS,
        select=f"SELECT event_id, ip, app, device, os, channel, is_fraud, {sql.time_text('click_time_ts', 'click_time_ts')} FROM flags WHERE is_valid_record",
    ),
)
def curate(spark, sf_dir):
    return trust_frames(typed_once(clicks_dirty(spark, sf_dir))).curated.select(
        "event_id", "ip", "app", "device", "os", "channel", "is_fraud", time_text("click_time_ts")
    )


@query(
    "tree_frame",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        sql.FEATURES,
        select="""
SELECT t.event_id,
  COALESCE(CAST(epoch_us(t.click_time_ts) // 1000000 AS DOUBLE), -1.0) AS click_time_ts,
  COALESCE(CAST(c.channel_code AS DOUBLE), -1.0) AS channel_text,
  COALESCE(CAST(t.device AS DOUBLE), -1.0) AS device,
  COALESCE(CAST(CAST(t.app_channel_freq > 20 AS INTEGER) AS DOUBLE), -1.0) AS frequent
FROM feats t JOIN clicks r ON t.event_id = r.event_id
LEFT JOIN (
  SELECT channel, dense_rank() OVER (ORDER BY channel) - 1 AS channel_code FROM (SELECT DISTINCT channel FROM clicks WHERE channel IS NOT NULL)) c
ON r.channel = c.channel
""",
    ),
)
def tree_frame(spark, sf_dir):
    from clickward.operators.features import trust_features

    raw = clicks_dirty(spark, sf_dir)
    features = trust_features(ops.cast_events(raw.withColumn("channel_text", F.col("channel"))))
    mixed = features.select(
        "event_id", "click_time_ts", "channel_text", "device", (F.col("app_channel_freq") > 20).alias("frequent")
    )
    return ops.tree_frame(mixed, keys=("event_id",))
