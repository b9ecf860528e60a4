"""Declarative data-quality rules, their report and the veracity score.

A rule can be undecided (NULL). An undecided rule is not counted as a
violation, but earns no score and does not pass curation.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickward.operators.ordering import Order, drop_helpers, prior_count, split_families, time_order
from clickward.operators.profile import NULL_NAME, PROFILE_COLUMNS, drift_psi_kl
from clickward.session import SkewPolicy

# The rules and their weights.
RULE_WEIGHTS = {
    "rule_schema_valid": 0.24,
    "rule_completeness": 0.20,
    "rule_range": 0.18,
    "rule_uniqueness": 0.15,
    "rule_drift": 0.13,
    "rule_outlier": 0.10,
}
RULES = tuple(RULE_WEIGHTS)
EARLIEST = datetime(2000, 1, 1)
FUTURE_SLACK = timedelta(days=2)
FENCE = 1.5
ID_COLUMNS = ("ip", "app", "device", "os", "channel")
DUPLICATE_KEY = ("ip", "app", "device", "os", "channel", "click_time_ts")


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def schema_valid() -> Column:
    return _all([F.col(c).isNotNull() for c in ("click_time_ts", *ID_COLUMNS)]) & F.col("is_fraud").isin(0, 1)


def completeness() -> Column:
    return _all([F.col(c).isNotNull() for c in ("click_time_ts", *ID_COLUMNS, "is_fraud")])


def in_range(as_of: datetime | None = None) -> Column:
    """Plausible time and non-negative ids. `as_of` is the clock (UTC, now by default)."""
    now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    low = F.lit(EARLIEST.isoformat(sep=" ")).cast("timestamp")
    high = F.lit((now + FUTURE_SLACK).isoformat(sep=" ")).cast("timestamp")
    return _all([F.col("click_time_ts").between(low, high), *[F.col(c) >= 0 for c in ID_COLUMNS]])


def mark_first_of_duplicates(
    df: DataFrame,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
    sizes_of: DataFrame | None = None,
    out: str = "rule_uniqueness",
) -> DataFrame:
    """TRUE for the first row of each identical event, FALSE for its repeats.

    The key starts with ip, so rows already partitioned by ip do not move. A
    large group of copies is cut along the row id like any other hot group.
    """
    order = order or time_order()
    rows, families = split_families(df, [("ip",), DUPLICATE_KEY], order, policy, sizes_of)
    earlier = prior_count(rows, families[DUPLICATE_KEY], order, "_earlier_copies", policy)
    return drop_helpers(earlier.withColumn(out, F.col("_earlier_copies") == 0).drop("_earlier_copies"))


def mark_known_values(
    df: DataFrame, baseline: DataFrame, out: str = "rule_drift", policy: SkewPolicy | None = None
) -> DataFrame:
    """Whether all profiled columns hold values of the baseline, however many it has.

    One join per column against its known values. They are broadcast when they
    were counted and are few; beyond that the join is shuffled.
    """
    policy = policy or SkewPolicy.of(df.sparkSession)
    few = baseline.limit(policy.broadcast_rows + 1).count() <= policy.broadcast_rows
    marks = []
    for c in PROFILE_COLUMNS:
        own = baseline.where(F.col("feature") == c).select(F.col("value").alias(f"_value_{c}")).distinct()
        own = own.withColumn(f"_known_{c}", F.lit(True))
        text = F.coalesce(F.col(c).cast("string"), F.lit(NULL_NAME))
        df = df.join(F.broadcast(own) if few else own, text == F.col(f"_value_{c}"), "left")
        # A missing value that the baseline does not have is undecided.
        marks.append(F.when(F.col(f"_known_{c}"), True).when(F.col(c).isNotNull(), False))
    helpers = [f"{kind}_{c}" for c in PROFILE_COLUMNS for kind in ("_value", "_known")]
    return df.withColumn(out, _all(marks)).drop(*helpers)


def _fences(quartiles: DataFrame) -> DataFrame:
    return (
        quartiles.select(F.col("q")[0].cast("double").alias("q1"), F.col("q")[1].cast("double").alias("q3"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumns(
            {"lower_bound": F.col("q1") - FENCE * F.col("iqr"), "upper_bound": F.col("q3") + FENCE * F.col("iqr")}
        )
    )


def outlier_bounds(df: DataFrame, column: str = "clicks_per_ip_per_hour") -> DataFrame:
    """One row: exact quartiles of the column, their distance and the fences.

    A group-size column over n rows has at most sqrt(2n) distinct values, so
    the histogram is small even where the frame is not.
    """
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return _fences(sizes.agg(F.expr("percentile(v, array(0.25, 0.75), n)").alias("q")))


def group_size_bounds(df: DataFrame, keys=("ip", "event_hour")) -> DataFrame:
    """`outlier_bounds` of the rows' group size, straight from the group counts.

    No row-level window runs: a group of n rows counts n times.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("v"))
    sizes = groups.groupBy("v").agg(F.sum("v").alias("n"))
    return _fences(sizes.agg(F.expr("percentile(v, array(0.25, 0.75), n)").alias("q")))


def mark_inside_fences(
    df: DataFrame, bounds: DataFrame, column: str = "clicks_per_ip_per_hour", out: str = "rule_outlier"
) -> DataFrame:
    """Whether the column lies inside the fences."""
    fence = F.col("_fence")
    inside = F.col(column).between(fence["lower_bound"], fence["upper_bound"])
    return df.withColumn("_fence", bounds.select(F.struct("*")).scalar()).withColumn(out, inside).drop("_fence")


def veracity_checks(
    df: DataFrame,
    baseline: DataFrame | None = None,
    as_of: datetime | None = None,
    bounds: DataFrame | None = None,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """All six flags and their conjunction. Without a baseline nothing has drifted."""
    fences = bounds if bounds is not None else outlier_bounds(df)
    flagged = mark_first_of_duplicates(df, order, policy, sizes_of).withColumns(
        {
            "rule_schema_valid": schema_valid(),
            "rule_completeness": completeness(),
            "rule_range": in_range(as_of),
            "rule_drift": F.lit(True),
        }
    )
    if baseline is not None:
        flagged = mark_known_values(flagged, baseline)
    flagged = mark_inside_fences(flagged, fences)
    return flagged.withColumn("is_valid_record", _all([F.col(r) for r in RULES]))


def validation_report(flags: DataFrame) -> DataFrame:
    """(rule, total, invalid_count, invalid_percent, unknown_count) in one pass."""
    counts = flags.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~F.col("rule_uniqueness")).alias("duplicates_removed"),
        *[F.count_if(~F.col(r)).alias(f"bad_{r}") for r in RULES],
        *[F.count_if(F.col(r).isNull()).alias(f"open_{r}") for r in RULES],
    )
    per_rule = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(r).alias("rule"),
                    F.col(f"bad_{r}").alias("invalid_count"),
                    F.col(f"open_{r}").alias("unknown_count"),
                )
                for r in RULES
            ]
        )
    )
    percent = F.when(F.col("total_records") > 0, F.col("r.invalid_count") * 100.0 / F.col("total_records"))
    return counts.select("total_records", "duplicates_removed", per_rule.alias("r")).select(
        "r.rule",
        "total_records",
        "duplicates_removed",
        "r.invalid_count",
        F.coalesce(percent, F.lit(0.0)).alias("invalid_percent"),
        "r.unknown_count",
    )


def validation_summary(flags: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row with the report, the drift metrics and the fences nested in it."""
    report = validation_report(flags).agg(
        F.max("total_records").alias("total_records"),
        F.max("duplicates_removed").alias("duplicates_removed"),
        F.map_from_entries(F.collect_list(F.struct("rule", "invalid_count"))).alias("invalid_counts_by_rule"),
        F.map_from_entries(F.collect_list(F.struct("rule", "invalid_percent"))).alias("invalid_percent_by_rule"),
    )
    drift = drift_psi_kl(flags, baseline).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("psi", "kl")))).alias("drift_metrics")
    )
    bounds = outlier_bounds(flags).select(F.struct("*").alias("outlier_bounds"))
    return report.withColumns({"drift_metrics": drift.scalar(), "outlier_bounds": bounds.scalar()})


def veracity_score(flags: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted share of passed rules. Given weights replace known ones; others are ignored."""
    used = {r: float((weights or {}).get(r, w)) for r, w in RULE_WEIGHTS.items()}
    total = sum(used.values())
    earned = reduce(lambda a, b: a + b, [F.when(F.col(r), w).otherwise(0.0) for r, w in used.items()])
    return flags.withColumn("veracity_score", (earned / F.lit(total)).cast("double"))
