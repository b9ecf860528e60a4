"""Value profiles of a frame and drift against a stored profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What drift is measured on, and how.
PROFILE_COLUMNS = ("app", "channel", "device", "os")
SHARE_FLOOR = 1e-6
NULL_NAME = "NULL"


def value_shares(df: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """(feature, value, n, share): all values of each column, with the share of all rows."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_NAME)).alias(c) for c in columns]
    counts = (
        df.select(*texts)
        .unpivot([], list(columns), "feature", "value")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    # One row per profiled column, so the broadcast has a fixed size.
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", "value", "n", (F.col("n") / F.col("total")).alias("share")
    )


def baseline_stats(
    df: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS, top: int | None = None
) -> DataFrame:
    """All values of each column, or its `top` most frequent ones, ties in text order."""
    if top is None:
        return value_shares(df, columns).select("feature", "value", "share")
    ranked = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value"))
    return (
        value_shares(df, columns)
        .withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= top)
        .select("feature", "value", "share")
    )


def drift_psi_kl(current: DataFrame, baseline: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """(feature, psi, kl) of the current frame against a baseline profile; both 0 for an empty frame."""
    now = value_shares(current, columns).select("feature", "value", F.col("share").alias("q"))
    then = baseline.select("feature", "value", F.col("share").alias("p"))
    p = F.greatest(F.coalesce("p", F.lit(SHARE_FLOOR)), F.lit(SHARE_FLOOR))
    q = F.greatest(F.coalesce("q", F.lit(SHARE_FLOOR)), F.lit(SHARE_FLOOR))
    return (
        now.join(then, ["feature", "value"], "full")
        .select("feature", p.alias("p"), q.alias("q"), F.col("q").isNotNull().alias("seen"))
        .groupBy("feature")
        .agg(
            F.bool_or("seen").alias("seen"),
            F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"),
            F.sum(F.col("q") * F.log(F.col("q") / F.col("p"))).alias("kl"),
        )
        .select("feature", *[F.when(F.col("seen"), F.col(m)).otherwise(0.0).alias(m) for m in ("psi", "kl")])
    )


def drift_long(drift: DataFrame) -> DataFrame:
    return drift.unpivot(["feature"], ["psi", "kl"], "metric", "value")


def score_distribution(df: DataFrame, target: str, score: str = "veracity_score", bins: int = 30) -> DataFrame:
    """Rows, share and density of each score bin per class; bins are [i/n, (i+1)/n), the last one closed."""
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(F.col(target).alias("label"), cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per_label = F.sum("n").over(Window.partitionBy("label"))
    return counts.select(
        "label", "bin", "n", (F.col("n") * F.lit(float(bins)) / per_label).alias("density")
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows and percent of the labels 0 and 1; a label that does not occur counts 0."""
    totals = df.agg(
        F.count_if(F.col(target) == 0).alias("n0"),
        F.count_if(F.col(target) == 1).alias("n1"),
    )
    each = F.explode(
        F.array(
            F.struct(F.lit(0).alias("label"), F.col("n0").alias("n")),
            F.struct(F.lit(1).alias("label"), F.col("n1").alias("n")),
        )
    )
    total = F.col("n0") + F.col("n1")
    return totals.select(each.alias("c"), total.alias("total")).select(
        "c.label",
        "c.n",
        F.when(F.col("total") > 0, F.col("c.n") * 100.0 / F.col("total")).otherwise(0.0).alias("percent"),
    )
