"""Classifier evaluation over a frame of (id, y, p), optionally per model.

All curves and areas work on score groups: one row per distinct score with its
positives and negatives, combined on the map side. Running sums along the
scores are cut into slices like any other large group, so continuous scores of
a huge frame do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickward.functions.metrics import all_class_metrics, f1, mcc, precision, recall
from clickward.operators.ordering import (
    Groups,
    attach,
    drop_helpers,
    number_order,
    prior_count,
    prior_sums,
    split_groups,
)
from clickward.session import SkewPolicy

# Where metrics are reported.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
TOP_K = (50, 100, 500, 1000)
CALIBRATION_BINS = 10
HISTOGRAM_BINS = 29
PARITY_METRICS = ("pr_auc", "f1", "mcc", "precision", "recall")
PARITY_TOLERANCE = 1e-9


def with_score(df: DataFrame) -> DataFrame:
    """Rows whose score is a number. NaN would rank above every score, so it is left out everywhere."""
    return df.where(F.col("p").isNotNull() & ~F.isnan(F.col("p").cast("double")))


def confusion(df: DataFrame, by: Sequence[str] = (), threshold: float | Column = 0.5) -> DataFrame:
    """The four counts at a threshold, and their shares of all rows."""
    hit, yes = F.col("p") >= threshold, F.col("y") == 1
    counts = with_score(df).groupBy(*by).agg(
        F.count_if(~hit & ~yes).alias("tn"),
        F.count_if(hit & ~yes).alias("fp"),
        F.count_if(~hit & yes).alias("fn"),
        F.count_if(hit & yes).alias("tp"),
    )
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    share = {f"{c}_share": F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in ("tn", "fp", "fn", "tp")}
    return counts.withColumns(share)


def class_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    counts = confusion(df, by, threshold)
    return counts.select(*by, "tn", "fp", "fn", "tp", *[c.alias(n) for n, c in all_class_metrics().items()])


def all_negative_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("y") == 0).cast("double")).alias("all_negative_accuracy"))


def score_groups(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, p, pos, neg): one row per distinct score."""
    return with_score(df).groupBy(*by, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )


def _with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str], groups: Groups, policy: SkewPolicy | None) -> DataFrame:
    if by:
        return attach(df, totals, groups, policy)
    row = totals.select(F.struct("*")).scalar()
    return df.withColumn("_row", row).withColumns({c: F.col("_row")[c] for c in totals.columns}).drop("_row")


def curve(df: DataFrame, by: Sequence[str] = (), policy: SkewPolicy | None = None) -> DataFrame:
    """Score groups with `tp`/`fp` (rows at or above the score) and the class totals."""
    groups = score_groups(df, by)
    order = number_order("p", descending=True)
    parted, family = split_groups(groups, by, order, policy)
    summed = prior_sums(
        parted, family, order, {"tp_before": F.col("pos"), "fp_before": F.col("neg")}, policy
    )
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return drop_helpers(_with_totals(summed, totals, by, family, policy)).withColumns(
        {"tp": F.col("tp_before") + F.col("pos"), "fp": F.col("fp_before") + F.col("neg")}
    )


def _area(sum_expr: Column, defined: Column) -> Column:
    return F.when(defined, sum_expr).otherwise(F.lit(float("nan")))


def areas(df: DataFrame, by: Sequence[str] = (), policy: SkewPolicy | None = None) -> DataFrame:
    """`roc_auc` (ties count half, NaN with one class) and `pr_auc` (step sum) from one curve."""
    points = curve(df, by, policy)
    negatives_below = F.sum(F.col("neg") * (F.col("tp_before") + F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    pos, neg = F.max("all_pos"), F.max("all_neg")
    return points.groupBy(*by).agg(
        _area(negatives_below / (pos * neg.cast("double")), (pos > 0) & (neg > 0)).alias("roc_auc"),
        F.when(pos > 0, steps / pos).otherwise(F.lit(0.0)).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), policy: SkewPolicy | None = None) -> DataFrame:
    return areas(df, by, policy).drop("pr_auc")


def pr_auc(df: DataFrame, by: Sequence[str] = (), policy: SkewPolicy | None = None) -> DataFrame:
    return areas(df, by, policy).drop("roc_auc")


def model_metrics(df: DataFrame, by: Sequence[str] = (), policy: SkewPolicy | None = None) -> DataFrame:
    """Counts, class metrics and both areas per model."""
    classes, area = class_metrics(df, by), areas(df, by, policy)
    if by:
        # Both sides have one row per model.
        return classes.join(area, list(by))
    return classes.withColumn("_row", area.select(F.struct("*")).scalar()).select(*classes.columns, "_row.*")


def roc_points(df: DataFrame, by: Sequence[str] = (), policy: SkewPolicy | None = None) -> DataFrame:
    return curve(df, by, policy).select(
        *by,
        F.col("p").alias("threshold"),
        F.when(F.col("all_neg") > 0, F.col("fp") / F.col("all_neg")).alias("fpr"),
        F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).alias("tpr"),
    )


def pr_points(df: DataFrame, by: Sequence[str] = (), policy: SkewPolicy | None = None) -> DataFrame:
    total = F.col("all_pos") + F.col("all_neg")
    return curve(df, by, policy).select(
        *by,
        F.col("p").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).otherwise(0.0).alias("recall"),
        (F.col("all_pos") / total).alias("prevalence"),
    )


def threshold_sweep(
    df: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Metrics at each threshold. All thresholds are counted in one pass over the rows."""
    yes = F.col("y") == 1
    sums = with_score(df).groupBy(*by).agg(
        F.count_if(yes).alias("all_pos"),
        F.count_if(~yes).alias("all_neg"),
        *[F.count_if(yes & (F.col("p") >= t)).alias(f"tp_{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(~yes & (F.col("p") >= t)).alias(f"fp_{i}") for i, t in enumerate(thresholds)],
    )
    each = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"))
            for i, t in enumerate(thresholds)
        ]
    )
    rows = sums.select(*by, "all_pos", "all_neg", F.explode(each).alias("r"))
    tp, fp = F.col("r.tp"), F.col("r.fp")
    fn, tn = F.col("all_pos") - tp, F.col("all_neg") - fp
    return rows.select(
        *by,
        "r.threshold",
        precision(tp, fp).alias("precision"),
        recall(tp, fn).alias("recall"),
        f1(tp, fp, fn).alias("f1"),
        mcc(tn, fp, fn, tp).alias("mcc"),
        (tp + fp).alias("positives_predicted"),
    )


def threshold_select(sweep: DataFrame) -> DataFrame:
    """The best threshold by F1, then MCC, then recall; the lowest of equals."""
    return sweep.orderBy(F.desc("f1"), F.desc("mcc"), F.desc("recall"), F.asc("threshold")).limit(1)


def topk_metrics(df: DataFrame, ks: Sequence[int] = TOP_K, tie: str = "id", policy: SkewPolicy | None = None) -> DataFrame:
    """Hits, precision, recall and lift among the k highest scores, ties by id.

    The top rows are a distributed top-k; only they are ranked.
    """
    most = max(ks)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(F.col("y") == 1).alias("pos_total")
    )
    top = df.orderBy(F.desc("p"), F.asc(tie)).limit(most)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p"), F.asc(tie))))
    hits = ranked.agg(
        *[F.count_if((F.col("y") == 1) & (F.col("place") <= max(1, k))).alias(f"h{k}") for k in ks]
    )
    both = hits.withColumn("t", totals.select(F.struct("*")).scalar())
    each = F.array(*[F.struct(F.lit(max(1, k)).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    rows = both.select(F.explode(each).alias("r"), "t.*").where(F.col("rows_total") > 0)
    k = F.least(F.col("r.k"), F.col("rows_total"))
    share = F.when(F.col("pos_total") > 0, F.col("r.hits") / F.col("pos_total")).otherwise(0.0)
    prevalence = F.col("pos_total") / F.col("rows_total")
    return rows.select(
        k.cast("bigint").alias("k"),
        F.col("r.hits").alias("hits"),
        (F.col("r.hits") / k).alias("precision_at_k"),
        share.alias("recall_at_k"),
        F.when(prevalence > 0, F.col("r.hits") / k / prevalence).otherwise(F.lit(float("nan"))).alias("lift_at_k"),
        share.alias("topk_capture"),
        prevalence.alias("prevalence"),
    )


def top_decile(df: DataFrame, tie: str = "id", policy: SkewPolicy | None = None) -> DataFrame:
    """Share of the positives among the tenth of the rows with the highest scores.

    Whole score groups above the cut are counted from the curve. Only the group
    the cut falls into is ranked by id, in slices if it is large.
    """
    points = curve(df, policy=policy).withColumn("n", F.col("pos") + F.col("neg"))
    total = F.col("all_pos") + F.col("all_neg")
    cut = F.greatest(F.lit(1), F.bround(total * 0.1)).cast("bigint")
    before = F.col("tp_before") + F.col("fp_before")
    summary = points.agg(
        F.max(cut).alias("top_decile_k"),
        F.max("all_pos").alias("pos_total"),
        F.coalesce(F.sum(F.when(before + F.col("n") <= cut, F.col("pos"))), F.lit(0)).alias("whole_hits"),
        F.max(F.when((before < cut) & (before + F.col("n") > cut), F.struct("p", (cut - before).alias("take")))).alias("edge"),
    )
    # One row, read from the curve once.
    at = summary.first()
    hits, edge = at["whole_hits"], at["edge"]
    if edge is not None:
        order = number_order(tie)
        parted, group = split_groups(df.where(F.col("p") == edge["p"]), [], order, policy)
        ranked = prior_count(parted, group, order, "_place", policy)
        hits += ranked.where((F.col("_place") < edge["take"]) & (F.col("y") == 1)).count()
    share = hits / at["pos_total"] if at["pos_total"] else 0.0
    return df.sparkSession.createDataFrame(
        [(at["top_decile_k"], hits, share)], "top_decile_k bigint, hits bigint, top_decile_capture double"
    )


def exact_quantiles(groups: DataFrame, shares: Sequence[float], policy: SkewPolicy | None = None) -> DataFrame:
    """(share, value): exact interpolated quantiles of `p` over (p, n) groups.

    Each asked rank lies in one group's range of ranks, so no list of values is
    built: the groups that hold an asked rank are few.
    """
    order = number_order("p")
    parted, whole = split_groups(groups, [], order, policy)
    placed = drop_helpers(prior_sums(parted, whole, order, {"start": F.col("n")}, policy))
    last = groups.agg((F.sum("n") - 1).alias("last")).scalar()
    first, after = F.col("start"), F.col("start") + F.col("n")
    picks = []
    for share in shares:
        at = F.lit(float(share)) * F.col("_last")
        for upper, rank in ((0, F.floor(at)), (1, F.ceil(at))):
            found = F.struct(F.lit(float(share)).alias("share"), (at - F.floor(at)).alias("t"), F.lit(upper).alias("upper"))
            picks.append(F.when((rank >= first) & (rank < after), found))
    found = placed.withColumn("_last", last).select("p", F.explode(F.array_compact(F.array(*picks))).alias("a"))
    low = F.max(F.when(F.col("a.upper") == 0, F.col("p")))
    high = F.max(F.when(F.col("a.upper") == 1, F.col("p")))
    return found.groupBy(F.col("a.share").alias("share")).agg(
        (low + (high - low) * F.max("a.t")).alias("value")
    )


def calibration_bins(df: DataFrame, bins: int = CALIBRATION_BINS, policy: SkewPolicy | None = None) -> DataFrame:
    """Mean score and observed rate per quantile bin; a score on an edge falls below it, empty bins vanish."""
    groups = score_groups(df).withColumn("n", F.col("pos") + F.col("neg"))
    edges = exact_quantiles(groups.select("p", "n"), [i / bins for i in range(1, bins)], policy)
    cuts = edges.agg(F.collect_list("value").alias("v")).scalar()
    number = reduce(lambda a, b: a + b, [(F.get("_cuts", F.lit(i)) < F.col("p")).cast("int") for i in range(bins - 1)])
    return (
        groups.withColumn("_cuts", cuts)
        .groupBy(number.alias("bin"))
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"),
            (F.sum("pos") / F.sum("n")).alias("observed"),
        )
    )


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"))


def prob_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows and density per class and equal bin of [0, 1]; scores outside are left out."""
    cell = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    counts = (
        df.where(F.col("p").between(0.0, 1.0))
        .groupBy("y", cell.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        "y", "bin", "n", (F.col("n") * F.lit(float(bins)) / F.sum("n").over(Window.partitionBy("y"))).alias("density")
    )


def _rank_value(name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name), F.lit(-1.0)), F.lit(-1.0))


def leaderboard(metrics: DataFrame, *tie: str) -> DataFrame:
    """Model rows, best first, with their `place`. A missing metric counts as -1.

    The frame has one row per model and variant.
    """
    keys = [_rank_value(c).desc() for c in ("val_pr_auc", "val_mcc", "val_f1")]
    order = [*keys, *[F.col(t).asc() for t in (tie or ("model",))]]
    return metrics.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def track_union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def metrics_long(metrics: DataFrame, ids: Sequence[str] = ("model",), names: Sequence[str] | None = None) -> DataFrame:
    used = list(names or ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc"))
    return metrics.unpivot(list(ids), used, "metric", "score")


def metric_parity(logged: DataFrame, predictions: DataFrame, by: Sequence[str] = ("model",), policy: SkewPolicy | None = None) -> DataFrame:
    """Largest difference between logged metrics and those recomputed from predictions.

    A logged model without predictions, or a metric that is no number on one
    side only, has no difference and does not pass.
    """
    again = model_metrics(predictions, by, policy).select(
        *by, *[F.col(m).alias(f"_again_{m}") for m in PARITY_METRICS], F.lit(True).alias("_found")
    )

    def number(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    pairs = [(number(m), number(f"_again_{m}")) for m in PARITY_METRICS]
    both_missing = [a.isNull() & b.isNull() for a, b in pairs]
    delta = [F.when(none, 0.0).otherwise(F.abs(a - b)) for none, (a, b) in zip(both_missing, pairs, strict=True)]
    known = F.coalesce(F.col("_found"), F.lit(False))
    for d in delta:
        known = known & d.isNotNull()
    return (
        logged.select(*by, *PARITY_METRICS)
        .join(again, list(by), "left")
        .select(*by, F.when(known, F.greatest(*delta)).alias("max_abs_delta"))
        .withColumn("parity_pass", F.coalesce(F.col("max_abs_delta") <= PARITY_TOLERANCE, F.lit(False)))
    )


def seed_stability(runs: DataFrame) -> DataFrame:
    """Absolute metric differences of the first two seeds. One row per seed comes in."""
    names = ("val_pr_auc", "val_mcc", "val_f1")
    along = Window.orderBy("seed")
    pairs = runs.withColumns(
        {"next_seed": F.lead("seed").over(along), **{f"next_{n}": F.lead(n).over(along) for n in names}}
    )
    return (
        pairs.where(F.col("next_seed").isNotNull())
        .orderBy("seed")
        .limit(1)
        .select(
            F.col("seed").alias("seed_a"),
            F.col("next_seed").alias("seed_b"),
            *[F.abs(F.col(n) - F.col(f"next_{n}")).alias(f"{n}_delta_abs") for n in names],
        )
    )
