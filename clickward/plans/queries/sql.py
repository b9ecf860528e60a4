"""SQL fragments: the common table expressions the registered SQL is built from."""

from __future__ import annotations


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


TIME = "'%Y-%m-%d %H:%M:%S.%f'"


def time_text(expr: str, name: str) -> str:
    return f"strftime({expr}, {TIME}) AS {name}"


CLEAN = f"""
clicks AS (
  SELECT event_id,
    strftime(ts, {TIME}) AS click_time,
    CAST(user_id AS VARCHAR) AS ip,
    CAST(CAST(floor(value) AS INTEGER) % 12 AS VARCHAR) AS app,
    CAST(k % 4 AS VARCHAR) AS device,
    CAST(9 + (k // 4) % 8 AS VARCHAR) AS os,
    CAST(100 + k % 40 AS VARCHAR) AS channel,
    CAST(NULL AS VARCHAR) AS is_fraud,
    CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END AS is_attributed,
    CASE WHEN event_type = 'purchase' THEN strftime(ts + INTERVAL 5 MINUTE, {TIME}) ELSE '' END AS attributed_time
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""

DIRTY = (
    CLEAN.replace("clicks AS (", "pure AS (", 1).strip()
    + """,
clicks AS (
  SELECT event_id,
    CASE WHEN event_id % 107 = 0 THEN 'bad' WHEN event_id % 131 = 0 THEN '1999-12-31 23:59:59' ELSE click_time END AS click_time,
    ip,
    CASE WHEN event_id % 103 = 0 THEN '-1' ELSE app END AS app,
    CASE WHEN event_id % 109 = 0 THEN 'abc' ELSE device END AS device,
    os,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 113 = 0 THEN channel || '.0' ELSE channel END AS channel,
    is_fraud,
    CASE WHEN event_id % 127 = 0 THEN NULL ELSE is_attributed END AS is_attributed,
    attributed_time
  FROM pure
  UNION ALL
  SELECT event_id + 1000000000, click_time, ip, app, device, os, channel, is_fraud, is_attributed, attributed_time
  FROM pure WHERE event_id % 97 = 0)
"""
)

TYPED = """
typed AS (
  SELECT event_id,
    TRY_CAST(click_time AS TIMESTAMP) AS click_time_ts,
    TRY_CAST(attributed_time AS TIMESTAMP) AS attributed_time_ts,
    TRY_CAST(ip AS BIGINT) AS ip,
    TRY_CAST(app AS INTEGER) AS app,
    TRY_CAST(device AS INTEGER) AS device,
    TRY_CAST(os AS INTEGER) AS os,
    TRY_CAST(channel AS INTEGER) AS channel,
    COALESCE(TRY_CAST(is_fraud AS INTEGER), 1 - TRY_CAST(is_attributed AS INTEGER)) AS is_fraud,
    TRY_CAST(is_attributed AS INTEGER) AS is_attributed
  FROM clicks)
"""

ORDER = "ORDER BY click_time_ts ASC NULLS FIRST, event_id"

FEATURES = f"""
parts AS (
  SELECT *,
    CAST(hour(click_time_ts) AS INTEGER) AS click_hour,
    CAST(day(click_time_ts) AS INTEGER) AS click_day,
    CAST(dayofweek(click_time_ts) + 1 AS INTEGER) AS click_weekday,
    CAST(minute(click_time_ts) AS INTEGER) AS click_minute,
    CAST(date_trunc('hour', click_time_ts) AS TIMESTAMP) AS event_hour
  FROM typed),
per_ip AS (
  SELECT ip, count(*) AS clicks_per_ip, count(DISTINCT channel) AS unique_channels_per_ip FROM typed GROUP BY ip),
per_pair AS (SELECT app, channel, count(*) AS app_channel_freq FROM typed GROUP BY app, channel),
feats AS (
  SELECT w.*, i.clicks_per_ip, i.unique_channels_per_ip, c.app_channel_freq,
    CASE WHEN prev_click_time IS NULL THEN 0.0::DOUBLE
      ELSE CAST(epoch_us(click_time_ts) // 1000000 - epoch_us(prev_click_time) // 1000000 AS DOUBLE) END AS inter_click_seconds
  FROM (
    SELECT *,
      count(*) OVER (PARTITION BY ip, event_hour) AS clicks_per_ip_per_hour,
      lag(click_time_ts) OVER (PARTITION BY ip {ORDER}) AS prev_click_time
    FROM parts) w
  LEFT JOIN per_ip i ON w.ip = i.ip
  LEFT JOIN per_pair c ON w.app = c.app AND w.channel = c.channel)
"""


def shares(source: str, name: str = "shares") -> str:
    one = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COALESCE(CAST({c} AS VARCHAR), 'NULL') AS value, count(*) AS n FROM {source} GROUP BY 2"
        for c in ("app", "channel", "device", "os")
    )
    return f"""
{name} AS (
  SELECT feature, value, n, n / (SELECT CAST(count(*) AS DOUBLE) FROM {source}) AS share FROM ({one}))
"""


def baseline(shares_name: str = "shares", name: str = "baseline", top: int | None = None) -> str:
    """All values of a profile, or the `top` most frequent of each feature."""
    if top is None:
        return f"""
{name} AS (SELECT feature, value, share FROM {shares_name})
"""
    return f"""
{name} AS (
  SELECT feature, value, share FROM (
    SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS place FROM {shares_name})
  WHERE place <= {top})
"""


def drift(current: str, name: str = "drift") -> str:
    return f"""
{name} AS (
  SELECT feature, sum((q - p) * ln(q / p)) AS psi, sum(q * ln(q / p)) AS kl FROM (
    SELECT COALESCE(s.feature, b.feature) AS feature,
      greatest(COALESCE(b.share, 1e-6), 1e-6) AS p, greatest(COALESCE(s.share, 1e-6), 1e-6) AS q
    FROM {current} s FULL OUTER JOIN baseline b ON s.feature = b.feature AND s.value = b.value)
  GROUP BY feature)
"""


BOUNDS = """
bounds AS (
  SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM (
    SELECT quantile_cont(CAST(clicks_per_ip_per_hour AS DOUBLE), 0.25) AS q1,
      quantile_cont(CAST(clicks_per_ip_per_hour AS DOUBLE), 0.75) AS q3 FROM feats))
"""

_SET = "({c} IN (SELECT CAST(value AS BIGINT) FROM baseline WHERE feature = '{c}' AND value <> 'NULL') OR ({c} IS NULL AND EXISTS (SELECT 1 FROM baseline WHERE feature = '{c}' AND value = 'NULL')))"
KNOWN = " AND ".join(_SET.format(c=c) for c in ("app", "channel", "device", "os"))

_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in ("click_time_ts", "ip", "app", "device", "os", "channel"))
SCHEMA_VALID = f"({_PRESENT} AND is_fraud IN (0, 1))"
COMPLETE = f"({_PRESENT} AND is_fraud IS NOT NULL)"
IN_RANGE = (
    "(click_time_ts BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '2024-02-03 00:00:00' AND "
    + " AND ".join(f"{c} >= 0" for c in ("ip", "app", "device", "os", "channel"))
    + ")"
)
FIRST_COPY = "(row_number() OVER (PARTITION BY ip, app, device, os, channel, click_time_ts ORDER BY event_id) = 1)"

FLAGS = f"""
flags AS (
  SELECT *, (rule_schema_valid AND rule_completeness AND rule_range AND rule_uniqueness AND rule_drift AND rule_outlier) AS is_valid_record
  FROM (
    SELECT *,
      {SCHEMA_VALID} AS rule_schema_valid,
      {COMPLETE} AS rule_completeness,
      {IN_RANGE} AS rule_range,
      {FIRST_COPY} AS rule_uniqueness,
      ({KNOWN}) AS rule_drift,
      (clicks_per_ip_per_hour BETWEEN (SELECT lower_bound FROM bounds) AND (SELECT upper_bound FROM bounds)) AS rule_outlier
    FROM feats))
"""

RULES = (
    "rule_schema_valid",
    "rule_completeness",
    "rule_range",
    "rule_uniqueness",
    "rule_drift",
    "rule_outlier",
)


def score(weights=(0.24, 0.20, 0.18, 0.15, 0.13, 0.10)) -> str:
    earned = " + ".join(
        f"CASE WHEN {r} THEN {w!r}::DOUBLE ELSE 0.0::DOUBLE END" for r, w in zip(RULES, weights)
    )
    return f"""
scored AS (SELECT *, ({earned}) / {sum(weights)!r}::DOUBLE AS veracity_score FROM flags)
"""


DIRTY_FLAGS = (DIRTY, TYPED, FEATURES, shares("typed"), baseline(), BOUNDS, FLAGS)

PREPARED = """
prepared AS (
  SELECT *, CAST(day(click_time_ts) AS INTEGER) AS day, CAST(hour(click_time_ts) AS INTEGER) AS hour,
    CAST(minute(click_time_ts) AS INTEGER) AS minute, CAST(second(click_time_ts) AS INTEGER) AS second
  FROM typed WHERE click_time_ts IS NOT NULL)
"""

INDEXED = """
indexed AS (SELECT *, row_number() OVER (ORDER BY click_time_ts, event_id) - 1 AS idx FROM prepared)
"""

SPLIT = """
parted AS (
  SELECT *, CASE WHEN idx < val_at THEN 'train' WHEN idx < test_at THEN 'val' ELSE 'test' END AS split
  FROM indexed, (
    SELECT val_at, greatest(val_at + 1, least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1)) AS test_at FROM (
      SELECT n, greatest(1, least(CAST(floor(n * 0.6::DOUBLE) AS BIGINT), n - 2)) AS val_at FROM (
        SELECT count(*) AS n FROM indexed))))
"""

CLEAN_SPLIT = (CLEAN, TYPED, PREPARED, INDEXED, SPLIT)

SCORED_ROWS = """
scores AS (
  SELECT event_id AS id, CAST(event_type = 'purchase' AS INTEGER) AS y,
    CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS p
  FROM events)
"""

MODEL_ROWS = """
rows_k AS (
  SELECT event_id AS id, CAST(event_type = 'purchase' AS INTEGER) AS y, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE WHEN event_id % 2 = 0 THEN 'val' ELSE 'test' END AS split
  FROM events),
model_scores AS (
  SELECT 'by_k' AS model, split, id, y, k / 100.0::DOUBLE AS p FROM rows_k
  UNION ALL SELECT 'by_value', split, id, y, (CAST(floor(value) AS INTEGER) % 100) / 100.0::DOUBLE FROM rows_k
  UNION ALL SELECT 'by_mix', split, id, y, (k + 37 * y) / 200.0::DOUBLE FROM rows_k)
"""


def points(source: str, by: str = "", name: str = "points") -> str:
    """Score groups with running counts from the highest score down."""
    keys, over = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""
{name} AS (
  SELECT {keys}p, pos, neg,
    sum(pos) OVER ({over}ORDER BY p DESC) AS tp, sum(neg) OVER ({over}ORDER BY p DESC) AS fp,
    sum(pos) OVER ({over}) AS all_pos, sum(neg) OVER ({over}) AS all_neg
  FROM (
    SELECT {keys}p, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY {keys}p))
"""


def areas(source: str = "points", by: str = "", name: str = "areas") -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
{name} AS (
  SELECT {keys}sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(all_pos) * CAST(max(all_neg) AS DOUBLE)) AS roc_auc,
    sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(all_pos) AS pr_auc
  FROM {source} {group})
"""


def confusion(source: str, by: str = "", name: str = "counts", threshold: str = "0.5") -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
{name} AS (
  SELECT {keys}count(*) FILTER (WHERE p < {threshold} AND y = 0) AS tn, count(*) FILTER (WHERE p >= {threshold} AND y = 0) AS fp,
    count(*) FILTER (WHERE p < {threshold} AND y = 1) AS fn, count(*) FILTER (WHERE p >= {threshold} AND y = 1) AS tp
  FROM {source} {group})
"""


PRECISION = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END"
RECALL = "CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END"
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END"
ACCURACY = "(tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE)"
MCC = (
    "CASE WHEN (tp + fp) > 0 AND (tp + fn) > 0 AND (tn + fp) > 0 AND (tn + fn) > 0 THEN "
    "(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / "
    "sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END"
)


def metric_columns(prefix: str = "") -> str:
    named = {"accuracy": ACCURACY, "precision": PRECISION, "recall": RECALL, "f1": F1, "mcc": MCC}
    return ", ".join(f"round({expr}, 6) AS {prefix}{name}" for name, expr in named.items())


def merkle(leaves: str = "leaves", name: str = "roots") -> str:
    """Roots per batch, level by level."""
    return f"""
levels AS (
  SELECT batch_id, 0 AS level, pos, record_hash AS node, count(*) OVER (PARTITION BY batch_id) AS n FROM {leaves}
  UNION ALL
  SELECT batch_id, level + 1, pos // 2, sha256(min_by(node, pos) || max_by(node, pos)), (n + 1) // 2
  FROM levels WHERE n > 1 GROUP BY batch_id, level, pos // 2, n),
{name} AS (
  SELECT l.batch_id, c.record_count, l.node AS merkle_root
  FROM levels l JOIN (SELECT batch_id, count(*) AS record_count FROM {leaves} GROUP BY batch_id) c ON l.batch_id = c.batch_id
  WHERE l.n = 1)
"""


CANONICAL = (
    "CAST(to_json({"
    + ", ".join(
        f"{c}: {c}"
        for c in sorted(
            (
                "event_id",
                "click_time",
                "ip",
                "app",
                "device",
                "os",
                "channel",
                "is_fraud",
                "is_attributed",
                "attributed_time",
            )
        )
    )
    + "}) AS VARCHAR)"
)
