"""Queries of rules, scores, profiles and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickward.operators import profile
from clickward.operators import rules as ops
from clickward.operators.clean import cast_events, time_parts
from clickward.operators.features import trust_features
from clickward.plans.queries import sql
from clickward.plans.queries.registry import AS_OF, query, rounded
from clickward.plans.trust import trust_frames, typed_once
from clickward.sources.adapters import clicks_clean, clicks_dirty


def _typed(spark, sf_dir):
    return cast_events(clicks_dirty(spark, sf_dir))


def _frames(spark, sf_dir):
    return trust_frames(typed_once(clicks_dirty(spark, sf_dir)), as_of=AS_OF)


def _flags_sql(*columns: str) -> str:
    return sql.with_(*sql.DIRTY_FLAGS, select=f"SELECT event_id, {', '.join(columns)} FROM flags")


def _typed_sql(expr: str, name: str) -> str:
    return sql.with_(sql.DIRTY, sql.TYPED, select=f"SELECT event_id, {expr} AS {name} FROM typed")


@query("rule_schema_valid", _typed_sql(sql.SCHEMA_VALID, "rule_schema_valid"))
def rule_schema_valid(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", ops.schema_valid().alias("rule_schema_valid"))


@query("rule_completeness", _typed_sql(sql.COMPLETE, "rule_completeness"))
def rule_completeness(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", ops.completeness().alias("rule_completeness"))


@query("rule_range", _typed_sql(sql.IN_RANGE, "rule_range"))
def rule_range(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", ops.in_range(AS_OF).alias("rule_range"))


@query("rule_uniqueness", _typed_sql(sql.FIRST_COPY, "rule_uniqueness"))
def rule_uniqueness(spark, sf_dir):
    return ops.mark_first_of_duplicates(_typed(spark, sf_dir)).select("event_id", "rule_uniqueness")


@query(
    "rule_drift",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        sql.TYPED.replace("typed AS (", "typed_clean AS (", 1).replace("FROM clicks)", "FROM pure)"),
        sql.shares("typed_clean"),
        sql.baseline(),
        select=f"SELECT event_id, ({sql.KNOWN}) AS rule_drift FROM typed",
    ),
)
def rule_drift(spark, sf_dir):
    """Dirty clicks against the whole profile of the clean ones."""
    known = profile.baseline_stats(cast_events(clicks_clean(spark, sf_dir)))
    return ops.mark_known_values(_typed(spark, sf_dir), known).select("event_id", "rule_drift")


BOUNDS = ("q1", "q3", "iqr", "lower_bound", "upper_bound")


@query(
    "outlier_bounds",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        sql.FEATURES,
        sql.BOUNDS,
        select=f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in BOUNDS)} FROM bounds",
    ),
)
def outlier_bounds(spark, sf_dir):
    return ops.group_size_bounds(time_parts(_typed(spark, sf_dir))).select(*rounded(*BOUNDS))


@query("rule_outlier", _flags_sql("rule_outlier"))
def rule_outlier(spark, sf_dir):
    features = trust_features(_typed(spark, sf_dir))
    return ops.mark_inside_fences(features, ops.outlier_bounds(features)).select("event_id", "rule_outlier")


@query("is_valid_record", _flags_sql("is_valid_record"))
def is_valid_record(spark, sf_dir):
    return _frames(spark, sf_dir).flags.select("event_id", "is_valid_record")


@query("veracity_checks", _flags_sql(*ops.RULES, "is_valid_record"))
def veracity_checks(spark, sf_dir):
    return _frames(spark, sf_dir).flags.select("event_id", *ops.RULES, "is_valid_record")


_REPORT = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, count(*) AS total_records, count(*) FILTER (WHERE NOT rule_uniqueness) AS duplicates_removed, "
    f"count(*) FILTER (WHERE NOT {r}) AS invalid_count, round(count(*) FILTER (WHERE NOT {r}) * 100.0::DOUBLE / count(*), 6) AS invalid_percent, "
    f"count(*) FILTER (WHERE {r} IS NULL) AS unknown_count FROM flags"
    for r in ops.RULES
)


def report_sql() -> str:
    return _REPORT


@query("validation_report", sql.with_(*sql.DIRTY_FLAGS, select=_REPORT))
def validation_report(spark, sf_dir):
    return ops.validation_report(_frames(spark, sf_dir).flags).select(
        "rule", "total_records", "duplicates_removed", "invalid_count", *rounded("invalid_percent"), "unknown_count"
    )


@query(
    "veracity_score",
    sql.with_(*sql.DIRTY_FLAGS, sql.score(), select="SELECT event_id, round(veracity_score, 6) AS veracity_score FROM scored"),
)
def veracity_score(spark, sf_dir):
    return _frames(spark, sf_dir).scored.select("event_id", *rounded("veracity_score"))


@query(
    "veracity_score_custom",
    sql.with_(
        *sql.DIRTY_FLAGS,
        sql.score((0.24, 0.20, 0.18, 0.5, 0.13, 1.0)),
        select="SELECT event_id, round(veracity_score, 6) AS veracity_score FROM scored",
    ),
)
def veracity_score_custom(spark, sf_dir):
    weights = {"rule_uniqueness": 0.5, "rule_outlier": 1.0, "rule_unheard_of": 9.0}
    return ops.veracity_score(_frames(spark, sf_dir).flags, weights).select("event_id", *rounded("veracity_score"))


@query(
    "score_distribution",
    sql.with_(
        *sql.DIRTY_FLAGS,
        sql.score(),
        select="""
SELECT label, bin, n, round(n * 30.0::DOUBLE / sum(n) OVER (PARTITION BY label), 6) AS density FROM (
  SELECT is_attributed AS label, CAST(least(floor(veracity_score * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1, 2)
""",
    ),
)
def score_distribution(spark, sf_dir):
    out = profile.score_distribution(_frames(spark, sf_dir).scored, "is_attributed")
    return out.select("label", "bin", "n", *rounded("density"))


@query(
    "baseline_stats",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        sql.shares("typed"),
        sql.baseline(top=32),
        select="SELECT feature, value, round(share, 6) AS share FROM baseline",
    ),
)
def baseline_stats(spark, sf_dir):
    return profile.baseline_stats(_typed(spark, sf_dir), top=32).select("feature", "value", *rounded("share"))


# Drift of the dirty clicks against a profile of the clean ones.
_TWO = (
    sql.DIRTY,
    sql.TYPED.replace("typed AS (", "typed_clean AS (", 1).replace("FROM clicks)", "FROM pure)"),
    sql.TYPED,
    sql.shares("typed_clean", "shares_clean"),
    sql.baseline("shares_clean"),
    sql.shares("typed", "shares_now"),
    sql.drift("shares_now"),
)


def _drift(spark, sf_dir):
    stored = profile.baseline_stats(cast_events(clicks_clean(spark, sf_dir)))
    return profile.drift_psi_kl(_typed(spark, sf_dir), stored)


@query("drift_psi_kl", sql.with_(*_TWO, select="SELECT feature, round(psi, 6) AS psi, round(kl, 6) AS kl FROM drift"))
def drift_psi_kl(spark, sf_dir):
    return _drift(spark, sf_dir).select("feature", *rounded("psi", "kl"))


@query(
    "drift_long",
    sql.with_(
        *_TWO,
        select="SELECT feature, 'psi' AS metric, round(psi, 6) AS value FROM drift UNION ALL SELECT feature, 'kl', round(kl, 6) FROM drift",
    ),
)
def drift_long(spark, sf_dir):
    return profile.drift_long(_drift(spark, sf_dir)).select("feature", "metric", *rounded("value"))


@query(
    "class_counts",
    sql.with_(
        sql.DIRTY,
        sql.TYPED,
        select="""
SELECT l.label, count(t.event_id) AS n,
  round(count(t.event_id) * 100.0::DOUBLE / (SELECT count(*) FROM typed WHERE is_attributed IN (0, 1)), 6) AS percent
FROM (SELECT 0 AS label UNION ALL SELECT 1) l LEFT JOIN typed t ON t.is_attributed = l.label GROUP BY l.label
""",
    ),
)
def class_counts(spark, sf_dir):
    return profile.class_counts(_typed(spark, sf_dir), "is_attributed").select("label", "n", *rounded("percent"))
