"""Queries of window and frequency features."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickward.operators import features as ops
from clickward.operators.clean import cast_events, prepare_events, time_parts
from clickward.operators.ordering import attach, group_size, split_families, split_groups, time_order
from clickward.plans.queries import sql
from clickward.plans.queries.registry import query, rounded, time_text
from clickward.sources.adapters import clicks_clean, clicks_dirty

ORDER = time_order()


def _typed(spark, sf_dir):
    return cast_events(clicks_dirty(spark, sf_dir))


def _prepared(spark, sf_dir):
    return prepare_events(cast_events(clicks_clean(spark, sf_dir)))


def _feature_sql(*columns: str) -> str:
    return sql.with_(sql.DIRTY, sql.TYPED, sql.FEATURES, select=f"SELECT event_id, {', '.join(columns)} FROM feats")


def _prepared_sql(*columns: str, parts: tuple[str, ...] = ()) -> str:
    return sql.with_(
        sql.CLEAN, sql.TYPED, sql.PREPARED, *parts, select=f"SELECT event_id, {', '.join(columns)} FROM {'work' if parts else 'prepared'}"
    )


@query("clicks_per_ip_per_hour", _feature_sql("clicks_per_ip_per_hour"))
def clicks_per_ip_per_hour(spark, sf_dir):
    base = time_parts(_typed(spark, sf_dir))
    rows, families = split_families(base, [("ip",), ("ip", "event_hour")], ORDER)
    return group_size(rows, families[("ip", "event_hour")], "clicks_per_ip_per_hour").select("event_id", "clicks_per_ip_per_hour")


@query("clicks_per_ip", _feature_sql("clicks_per_ip"))
def clicks_per_ip(spark, sf_dir):
    base = _typed(spark, sf_dir)
    rows, by_ip = split_groups(base, ["ip"], ORDER)
    return attach(rows, ops.ip_totals(base), by_ip).select("event_id", "clicks_per_ip")


@query("prev_click_time", _feature_sql(sql.time_text("prev_click_time", "prev_click_time")))
def prev_click_time(spark, sf_dir):
    rows, by_ip = split_groups(_typed(spark, sf_dir), ["ip"], ORDER)
    return ops.previous_click(rows, by_ip, ORDER).select("event_id", time_text("prev_click_time"))


@query("inter_click_seconds", _feature_sql("inter_click_seconds"))
def inter_click_seconds(spark, sf_dir):
    rows, by_ip = split_groups(_typed(spark, sf_dir), ["ip"], ORDER)
    return ops.previous_click(rows, by_ip, ORDER).select("event_id", "inter_click_seconds")


@query("unique_channels_per_ip", _feature_sql("unique_channels_per_ip"))
def unique_channels_per_ip(spark, sf_dir):
    base = _typed(spark, sf_dir)
    rows, by_ip = split_groups(base, ["ip"], ORDER)
    return attach(rows, ops.ip_totals(base), by_ip).select("event_id", "unique_channels_per_ip")


@query("app_channel_freq", _feature_sql("app_channel_freq"))
def app_channel_freq(spark, sf_dir):
    base = _typed(spark, sf_dir)
    return ops.app_channel_freq(base, ORDER).select("event_id", "app_channel_freq")


TRUST = (
    "click_hour",
    "click_day",
    "click_weekday",
    "click_minute",
    "clicks_per_ip_per_hour",
    "clicks_per_ip",
    "inter_click_seconds",
    "unique_channels_per_ip",
    "app_channel_freq",
)


@query("trust_features", _feature_sql(*TRUST, sql.time_text("prev_click_time", "prev_click_time")))
def trust_features(spark, sf_dir):
    return ops.trust_features(_typed(spark, sf_dir)).select("event_id", *TRUST, time_text("prev_click_time"))


def _prior(keys: str) -> str:
    return f"row_number() OVER (PARTITION BY {keys} {sql.ORDER}) - 1"


PRIOR = {name: ", ".join(keys) for name, keys in ops.COUNT_FAMILIES.items()}


@query("prior_counts", _prepared_sql(*[f"{_prior(k)} AS {n}" for n, k in PRIOR.items()]))
def prior_counts(spark, sf_dir):
    return ops.count_features(_prepared(spark, sf_dir)).select("event_id", *PRIOR)


def _prior_unique_sql(keys: str, value: str, name: str) -> str:
    work = f"""
work AS (
  SELECT event_id, COALESCE(CAST(sum(first) OVER (
      PARTITION BY {keys} {sql.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS {name}
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys}, {value} {sql.ORDER}) = 1 AS INTEGER) AS first FROM prepared))
"""
    return _prepared_sql(name, parts=(work,))


@query("prior_unique_single", _prior_unique_sql("ip", "app", "ip_unique_app_count"))
def prior_unique_single(spark, sf_dir):
    rows, families = split_families(_prepared(spark, sf_dir), [("ip",), ("ip", "app")], ORDER)
    return ops.prior_unique(rows, families[("ip",)], families[("ip", "app")], ORDER, "ip_unique_app_count").select(
        "event_id", "ip_unique_app_count"
    )


@query("prior_unique_pair", _prior_unique_sql("ip, app", "channel", "ip_app_unique_channel_count"))
def prior_unique_pair(spark, sf_dir):
    return ops.count_features(_prepared(spark, sf_dir)).select("event_id", "ip_app_unique_channel_count")


@query(
    "cumcount_aliases",
    _prepared_sql(
        f"{_prior('ip')} AS cumcount_ip",
        f"{_prior('ip, app')} AS cumcount_ip_app",
        f"{_prior('ip, device, os')} AS cumcount_ip_device_os",
    ),
)
def cumcount_aliases(spark, sf_dir):
    return ops.count_features(_prepared(spark, sf_dir), ops.Track.TRANSDUCTIVE).select(
        "event_id", *ops.CUMULATIVE_NAMES
    )


@query("total_counts", _prepared_sql(*[f"count(*) OVER (PARTITION BY {k}) AS {n}" for n, k in PRIOR.items()]))
def total_counts(spark, sf_dir):
    return ops.count_features(_prepared(spark, sf_dir), ops.Track.TRANSDUCTIVE).select("event_id", *PRIOR)


@query(
    "total_uniques",
    sql.with_(
        sql.CLEAN,
        sql.TYPED,
        sql.PREPARED,
        select="""
SELECT p.event_id, a.n AS ip_unique_app_count, c.n AS ip_app_unique_channel_count FROM prepared p
JOIN (SELECT ip, count(DISTINCT app) AS n FROM prepared GROUP BY ip) a ON p.ip = a.ip
JOIN (SELECT ip, app, count(DISTINCT channel) AS n FROM prepared GROUP BY ip, app) c ON p.ip = c.ip AND p.app = c.app
""",
    ),
)
def total_uniques(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    rows, families = split_families(prepared, [("ip",), ("ip", "app")], ORDER)
    return ops.total_uniques(rows, prepared, families[("ip",)], families[("ip", "app")]).select(
        "event_id", "ip_unique_app_count", "ip_app_unique_channel_count"
    )


def _gap(start: str, end: str) -> str:
    return f"round(COALESCE(greatest((epoch_us({end}) - epoch_us({start})) / 1e6::DOUBLE, 0.0), 0.0), 6)"


def _lag(keys: str) -> str:
    return f"lag(click_time_ts) OVER (PARTITION BY {keys} {sql.ORDER})"


def _lead(keys: str) -> str:
    return f"lead(click_time_ts) OVER (PARTITION BY {keys} {sql.ORDER})"


@query("prev_delta_ip", _prepared_sql(f"{_gap(_lag('ip'), 'click_time_ts')} AS prev_click_delta_sec_ip"))
def prev_delta_ip(spark, sf_dir):
    return ops.delta_features(_prepared(spark, sf_dir)).select("event_id", *rounded("prev_click_delta_sec_ip"))


@query("prev_delta_ip_app", _prepared_sql(f"{_gap(_lag('ip, app'), 'click_time_ts')} AS prev_click_delta_sec_ip_app"))
def prev_delta_ip_app(spark, sf_dir):
    return ops.delta_features(_prepared(spark, sf_dir)).select("event_id", *rounded("prev_click_delta_sec_ip_app"))


@query("next_delta_ip", _prepared_sql(f"{_gap('click_time_ts', _lead('ip'))} AS next_click_delta_sec_ip"))
def next_delta_ip(spark, sf_dir):
    rows = ops.delta_features(_prepared(spark, sf_dir), ops.Track.TRANSDUCTIVE, next_click=True)
    return rows.select("event_id", *rounded("next_click_delta_sec_ip"))
