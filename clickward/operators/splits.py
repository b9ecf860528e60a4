"""Chronological splits, their support and the search for a large enough window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickward.operators.features import Track
from clickward.operators.ordering import (
    Order,
    drop_helpers,
    global_index,
    group_stats,
    number_order,
    prior_count,
    prior_sums,
    split_groups,
    time_order,
)
from clickward.session import SkewPolicy, materialize

MIN_ROWS = 30
# Rows of the whole order that one task places.
PLACED_ROWS = 250_000
# Most positions that one block of the window search holds.
BLOCK_ROWS = 100_000
TEMPORAL = "strict_temporal"
BY_DAY = "competition_day_hour_style"
BY_DAY_FALLBACK = "competition_like_fallback_temporal"


def _edges(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """First validation and first test position in a window of n rows, each part at least one row."""
    start_val = F.greatest(F.lit(1), F.least(F.floor(n * F.lit(train)), n - 2))
    start_test = F.greatest(start_val + 1, F.least(F.floor(n * F.lit(train + val)), n - 1))
    return start_val.cast("bigint"), start_test.cast("bigint")


def temporal_split(
    df: DataFrame,
    train: float = 0.6,
    val: float = 0.2,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add `idx` (position in time), `split` and `strategy`: the first 60 % of
    the rows train, the next 20 % validate, the rest test."""
    rows = df.count() if rows is None else rows
    if rows < MIN_ROWS:
        raise ValueError(f"Too few rows to split by time: {rows} of {MIN_ROWS}")
    indexed = df if "idx" in df.columns else global_index(df, order or time_order(), "idx", policy)
    start_val, start_test = _edges(F.lit(rows), train, val)
    split = F.when(F.col("idx") < start_val, "train").when(F.col("idx") < start_test, "val").otherwise("test")
    return indexed.withColumns({"split": split, "strategy": F.lit(TEMPORAL)})


def competition_split(
    df: DataFrame,
    ts: str = "click_time_ts",
    day_of_month: bool = False,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Add `split` and `strategy`: the last day tests, the one before validates.

    Days are calendar days; `day_of_month` orders by day number instead, which
    mixes up months. With fewer than three days the split is by position.
    """
    day = F.dayofmonth(ts) if day_of_month else F.to_date(ts)
    last = [r["d"] for r in df.select(day.alias("d")).where(F.col("d").isNotNull()).distinct().orderBy(F.desc("d")).limit(3).collect()]
    if len(last) < 3:
        return temporal_split(df, order=order, policy=policy).withColumn("strategy", F.lit(BY_DAY_FALLBACK))
    split = F.when(day == F.lit(last[0]), "test").when(day == F.lit(last[1]), "val").otherwise("train")
    return df.withColumns({"split": split, "strategy": F.lit(BY_DAY)})


def split_support(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("split_rows"), F.sum(F.col(target)).cast("bigint").alias("positives")
    )


def split_overlap(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """Rows that two splits share, per pair of splits.

    Each row id gets the set of its splits; the pairs are then plain counts.
    """
    member = df.groupBy(tie).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    )
    return member.agg(
        F.coalesce(F.sum(F.col("train") * F.col("val")), F.lit(0)).alias("train_val"),
        F.coalesce(F.sum(F.col("train") * F.col("test")), F.lit(0)).alias("train_test"),
        F.coalesce(F.sum(F.col("val") * F.col("test")), F.lit(0)).alias("val_test"),
    )


def temporal_order_check(df: DataFrame, ts: str = "click_time_ts") -> DataFrame:
    """One row: whether train ends before validation begins, and that before test."""

    def of(split: str) -> Column:
        return F.when(F.col("split") == split, F.col(ts))

    ends = df.agg(
        F.max(of("train")).alias("train_end"),
        F.min(of("val")).alias("val_start"),
        F.max(of("val")).alias("val_end"),
        F.min(of("test")).alias("test_start"),
    )
    ordered = (F.col("train_end") <= F.col("val_start")) & (F.col("val_end") <= F.col("test_start"))
    return ends.withColumn("temporal_order_valid", F.coalesce(ordered, F.lit(False)))


def class_prevalence(df: DataFrame, target: str) -> DataFrame:
    """Positive rate per split and overall."""
    return (
        df.rollup("split")
        .agg(F.avg(target).alias("prevalence"), F.count(F.lit(1)).alias("split_rows"))
        .withColumn("split", F.coalesce("split", F.lit("overall")))
    )


def placed_rows(
    df: DataFrame,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
    counts: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The rows with their position `idx`, written once for the window search and the choice after it.

    `counts` names key families of which the earlier rows are counted as well. They are counted in the slices of the
    whole order, so that a family of a few large groups moves no row and holds no task longer than another. A family with
    too many groups for a broadcast is left out. What precedes a row is the same in every head window.
    """
    order, policy = order or time_order(), policy or SkewPolicy.of(df.sparkSession)
    small = replace(policy, max_group_rows=min(policy.max_group_rows, PLACED_ROWS))
    parted, whole = split_groups(df, [], order, small)
    placed = prior_count(parted, whole, order, "idx", policy)
    families = {n: tuple(keys) for n, keys in (counts or {}).items()}
    stats = group_stats(df, list(families.values())) if families else {}
    for name, keys in families.items():
        if stats[keys].groups * max(1, whole.slices) <= policy.broadcast_rows:
            groups = replace(whole, keys=keys, hot_keys=stats[keys].groups)
            placed = prior_count(placed, groups, order, name, policy, parted)
    return materialize(drop_helpers(placed), "placed")


def _sums_before(indexed: DataFrame, asked: DataFrame, few: bool, width: int, policy: SkewPolicy | None) -> DataFrame:
    """(at, before): the sum of `y` over all positions before each asked one, by blocks of `width` positions.

    With `few` asked positions they are broadcast, and no row leaves its task before its block is summed.
    """

    def block(name: str) -> Column:
        return (F.col(name) - F.col(name) % width).alias("block")

    sums = indexed.groupBy(block("idx")).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("y"))
    # The end of the last window may lie behind the last block.
    end = indexed.agg(F.max("idx").alias("idx")).select((block("idx") + width).alias("block"), F.lit(0).cast("bigint").alias("y"))
    along = number_order("block")
    parted, whole = split_groups(materialize(sums.unionByName(end), "blocks"), [], along, policy)
    earlier = drop_helpers(prior_sums(parted, whole, along, {"earlier": F.col("y")}, policy)).select("block", "earlier")
    edges = asked.select("at", block("at"))
    opened = indexed.withColumn("block", block("idx")).join(F.broadcast(edges) if few else edges, "block")
    inside = opened.groupBy("at").agg(F.coalesce(F.sum(F.when(F.col("idx") < F.col("at"), F.col("y"))), F.lit(0)).alias("inside"))
    before = F.col("earlier") + F.coalesce("inside", F.lit(0))
    return edges.join(earlier, "block").join(inside, "at", "left").select("at", before.cast("bigint").alias("before"))


def window_attempts(
    df: DataFrame,
    target: str,
    row_cap: int | None,
    step: int,
    min_val: int,
    min_test: int,
    track: Track = Track.CAUSAL,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Support of every candidate window, and the one selected.

    Candidates are the first `row_cap` rows, then `step` more each time, up to
    all rows; the smallest one with enough positives in validation and test is
    selected. Positives are summed once per block of at most `step` positions;
    the rows of a block are looked at again only where an edge of a candidate
    falls inside it, and a block holds few edges, as candidates are a step
    apart. The
    attempt on the trailing rows, made when no head window suffices, sees the
    same full frame. A frame that has `idx` already (`placed_rows`) is not
    ordered again.
    """
    if step <= 0 or (row_cap is not None and row_cap <= 0):
        raise ValueError("A window and its step have at least one row")
    order = order or time_order()
    ts = order.columns[0]
    spark = df.sparkSession
    indexed = df if "idx" in df.columns else placed_rows(df, order, policy)
    indexed = indexed.select("idx", F.col(target).cast("bigint").alias("y"), F.to_date(ts).alias("day"))
    n = indexed.count()
    if n < MIN_ROWS:
        raise ValueError(f"Too few rows to look for a window: {n} of {MIN_ROWS}")
    first = n if row_cap is None else min(row_cap, n)
    caps = spark.range(first, n, step).union(spark.range(n, n + 1)).withColumnRenamed("id", "cap")
    start_val, start_test = _edges(F.col("cap"), 0.6, 0.2)
    windows = caps.select("cap", start_val.alias("val_at"), start_test.alias("test_at"))
    if Track(track) is Track.TRANSDUCTIVE:
        windows = _day_edges(windows, indexed)

    asked = windows.select(F.explode(F.array("val_at", "test_at", "cap")).alias("at")).distinct()
    edges = 3 * ((n - first) // step + 2)
    few = edges <= (policy or SkewPolicy.of(spark)).broadcast_rows
    prefix = _sums_before(indexed, asked, few, min(step, BLOCK_ROWS), policy)

    def at(name: str) -> DataFrame:
        return prefix.withColumnsRenamed({"at": name, "before": f"pos_{name}"})

    support = windows.join(at("val_at"), "val_at").join(at("test_at"), "test_at").join(at("cap"), "cap")
    enough = (F.col("val_pos") >= min_val) & (F.col("test_pos") >= min_test)
    counted = support.select(
        F.lit("head").alias("window"),
        "cap",
        F.col("val_at").alias("train_rows"),
        (F.col("test_at") - F.col("val_at")).alias("val_rows"),
        (F.col("cap") - F.col("test_at")).alias("test_rows"),
        F.col("pos_val_at").alias("train_pos"),
        (F.col("pos_test_at") - F.col("pos_val_at")).alias("val_pos"),
        (F.col("pos_cap") - F.col("pos_test_at")).alias("test_pos"),
    ).withColumn("enough", enough)
    best = counted.agg(F.min(F.when(F.col("enough"), F.col("cap"))).alias("best"))
    # Later caps were never attempted.
    tried = counted.withColumn("best", best.scalar()).where(F.col("best").isNull() | (F.col("cap") <= F.col("best")))
    trailing = (
        tried.where(F.col("best").isNull() & (F.col("cap") == n))
        .withColumn("window", F.lit("trailing"))
    )
    return tried.unionByName(trailing).withColumn(
        "selected", F.coalesce(F.col("cap") == F.col("best"), F.lit(False))
    ).drop("best", "enough")


def _day_edges(windows: DataFrame, indexed: DataFrame) -> DataFrame:
    """Edges at the starts of the window's last two days; by share below three days.

    The list of day starts is bounded by the calendar, not by the rows.
    """
    starts = indexed.groupBy("day").agg(F.min("idx").alias("start")).select("start").collect()
    days = F.array(*[F.lit(r["start"]) for r in sorted(starts)])
    inside = F.filter(days, lambda s: s < F.col("cap"))
    enough = F.size("inside") >= 3
    return (
        windows.withColumn("inside", inside)
        .withColumns(
            {
                "val_at": F.when(enough, F.try_element_at("inside", F.lit(-2))).otherwise(F.col("val_at")),
                "test_at": F.when(enough, F.try_element_at("inside", F.lit(-1))).otherwise(F.col("test_at")),
            }
        )
        .drop("inside")
    )


def select_window(df: DataFrame, target: str, attempts: DataFrame, order: Order | None = None, policy: SkewPolicy | None = None) -> DataFrame:
    """The rows of the selected window, with their position; an error lists the attempts."""
    chosen = attempts.where("selected").select("cap").first()
    if chosen is None:
        last = attempts.orderBy(F.desc("cap"), "window").limit(10).collect()
        tried = "; ".join(f"{r['window']} cap={r['cap']} val_pos={r['val_pos']} test_pos={r['test_pos']}" for r in last)
        raise ValueError(f"No window has enough positives. Tried: {tried}")
    indexed = df if "idx" in df.columns else global_index(df, order or time_order(), "idx", policy)
    return indexed.where(F.col("idx") < chosen["cap"])
