"""Queries of splits, support, window search and bags."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickward.operators import sampling
from clickward.operators import splits as ops
from clickward.operators.clean import cast_events, prepare_events
from clickward.operators.features import Track
from clickward.operators.ordering import global_index as position
from clickward.operators.ordering import time_order
from clickward.plans.queries import sql
from clickward.plans.queries.registry import query, rounded, time_text
from clickward.sources.adapters import clicks_clean

TARGET = "is_attributed"


def _prepared(spark, sf_dir):
    return prepare_events(cast_events(clicks_clean(spark, sf_dir)))


def _split(spark, sf_dir):
    return ops.temporal_split(_prepared(spark, sf_dir))


def _sql(select: str, *parts: str) -> str:
    return sql.with_(*sql.CLEAN_SPLIT, *parts, select=select)


@query("global_index", _sql("SELECT event_id, idx FROM indexed"))
def global_index(spark, sf_dir):
    return position(_prepared(spark, sf_dir), time_order()).select("event_id", "idx")


@query("temporal_split", _sql("SELECT event_id, idx, split, 'strict_temporal' AS strategy FROM parted"))
def temporal_split(spark, sf_dir):
    return _split(spark, sf_dir).select("event_id", "idx", "split", "strategy")


_BY_DAY = """
by_day AS (
  SELECT *, CASE WHEN place = 1 THEN 'test' WHEN place = 2 THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, dense_rank() OVER (ORDER BY CAST(click_time_ts AS DATE) DESC) AS place FROM prepared))
"""


@query(
    "competition_split",
    _sql("SELECT event_id, split, 'competition_day_hour_style' AS strategy FROM by_day", _BY_DAY),
)
def competition_split(spark, sf_dir):
    return ops.competition_split(_prepared(spark, sf_dir)).select("event_id", "split", "strategy")


@query(
    "split_support",
    _sql(
        "SELECT split, count(*) AS split_rows, CAST(sum(is_attributed) AS BIGINT) AS positives FROM parted GROUP BY split"
    ),
)
def split_support(spark, sf_dir):
    return ops.split_support(_split(spark, sf_dir), TARGET)


WINDOW = {"row_cap": 400, "step": 150, "min_val": 60, "min_test": 70}

_WINDOW_SQL = """
totals AS (SELECT count(*) AS n FROM indexed),
caps AS (
  SELECT unnest(range(least(400, n), n, 150)) AS cap FROM totals UNION SELECT n FROM totals),
edges AS (
  SELECT cap, val_at, greatest(val_at + 1, least(CAST(floor(cap * 0.8::DOUBLE) AS BIGINT), cap - 1)) AS test_at FROM (
    SELECT cap, greatest(1, least(CAST(floor(cap * 0.6::DOUBLE) AS BIGINT), cap - 2)) AS val_at FROM caps)),
prefix AS (
  SELECT idx, CAST(sum(is_attributed) OVER (ORDER BY idx) - is_attributed AS BIGINT) AS before FROM indexed
  UNION ALL SELECT (SELECT n FROM totals), (SELECT CAST(sum(is_attributed) AS BIGINT) FROM indexed)),
support AS (
  SELECT cap, val_at AS train_rows, test_at - val_at AS val_rows, cap - test_at AS test_rows,
    a.before AS train_pos, b.before - a.before AS val_pos, c.before - b.before AS test_pos
  FROM edges e JOIN prefix a ON a.idx = e.val_at JOIN prefix b ON b.idx = e.test_at JOIN prefix c ON c.idx = e.cap),
best AS (SELECT min(cap) AS best FROM support WHERE val_pos >= 60 AND test_pos >= 70)
"""


@query(
    "row_window_select",
    _sql(
        """
SELECT 'head' AS "window", s.*, COALESCE(cap = best, false) AS selected FROM support s, best WHERE best IS NULL OR cap <= best
UNION ALL SELECT 'trailing', s.*, false FROM support s, best, totals WHERE best IS NULL AND cap = n
""",
        _WINDOW_SQL,
    ),
)
def row_window_select(spark, sf_dir):
    return ops.window_attempts(_prepared(spark, sf_dir), TARGET, **WINDOW)


@query(
    "split_overlap",
    _sql(
        """
SELECT CAST(count(*) FILTER (WHERE t AND v) AS BIGINT) AS train_val, CAST(count(*) FILTER (WHERE t AND s) AS BIGINT) AS train_test,
  CAST(count(*) FILTER (WHERE v AND s) AS BIGINT) AS val_test
FROM (SELECT event_id, bool_or(split = 'train') AS t, bool_or(split = 'val') AS v, bool_or(split = 'test') AS s FROM parted GROUP BY event_id)
"""
    ),
)
def split_overlap(spark, sf_dir):
    return ops.split_overlap(_split(spark, sf_dir))


@query(
    "temporal_order_check",
    _sql(
        f"""
SELECT {sql.time_text('train_end', 'train_end')}, {sql.time_text('val_start', 'val_start')},
  {sql.time_text('val_end', 'val_end')}, {sql.time_text('test_start', 'test_start')},
  train_end <= val_start AND val_end <= test_start AS temporal_order_valid
FROM (
  SELECT max(click_time_ts) FILTER (WHERE split = 'train') AS train_end, min(click_time_ts) FILTER (WHERE split = 'val') AS val_start,
    max(click_time_ts) FILTER (WHERE split = 'val') AS val_end, min(click_time_ts) FILTER (WHERE split = 'test') AS test_start
  FROM parted)
"""
    ),
)
def temporal_order_check(spark, sf_dir):
    return ops.temporal_order_check(_split(spark, sf_dir)).select(
        *[time_text(c) for c in ("train_end", "val_start", "val_end", "test_start")], "temporal_order_valid"
    )


@query(
    "class_prevalence",
    _sql(
        "SELECT COALESCE(split, 'overall') AS split, round(avg(is_attributed), 6) AS prevalence, count(*) AS split_rows FROM parted GROUP BY ROLLUP (split)"
    ),
)
def class_prevalence(spark, sf_dir):
    return ops.class_prevalence(_split(spark, sf_dir), TARGET).select("split", *rounded("prevalence"), "split_rows")


def _bag_sql(seed: int, name: str, ratio: int) -> str:
    return f"""
{name} AS (
  SELECT event_id, is_attributed FROM (
    SELECT event_id, is_attributed, row_number() OVER (PARTITION BY is_attributed ORDER BY md5('{seed}:' || event_id), event_id) AS place,
      sum(is_attributed) OVER () AS pos
    FROM typed)
  WHERE is_attributed = 1 OR place <= greatest(pos, pos * {ratio}))
"""


@query(
    "bag_subsample",
    sql.with_(sql.CLEAN, sql.TYPED, _bag_sql(42, "bag", 2), select="SELECT event_id, is_attributed FROM bag"),
)
def bag_subsample(spark, sf_dir):
    typed = cast_events(clicks_clean(spark, sf_dir))
    return sampling.bag_subsample(typed, TARGET, 2, 42).select("event_id", TARGET)


def _pair(a: int, b: int) -> str:
    return f"""
SELECT {a} AS bag_a, {b} AS bag_b, shared, either, round(shared / CAST(greatest(1, either) AS DOUBLE), 6) AS jaccard FROM (
  SELECT (SELECT count(*) FROM bag{a} x JOIN bag{b} y USING (event_id) WHERE x.is_attributed = 0) AS shared,
    (SELECT count(*) FROM (SELECT event_id FROM bag{a} WHERE is_attributed = 0 UNION SELECT event_id FROM bag{b} WHERE is_attributed = 0)) AS either)
"""


@query(
    "bag_overlap",
    sql.with_(
        sql.CLEAN,
        sql.TYPED,
        *[_bag_sql(42 + i, f"bag{i}", 2) for i in range(3)],
        select=" UNION ALL ".join(_pair(a, b) for a, b in ((0, 1), (0, 2), (1, 2))),
    ),
)
def bag_overlap(spark, sf_dir):
    typed = cast_events(clicks_clean(spark, sf_dir))
    bags = [sampling.bag_subsample(typed, TARGET, 2, 42 + i) for i in range(3)]
    return sampling.bag_overlap(bags, TARGET).select("bag_a", "bag_b", "shared", "either", *rounded("jaccard"))
