"""Queries of classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickward.operators import evaluate as ops
from clickward.operators.sampling import ensemble_mean
from clickward.plans.queries import sql
from clickward.plans.queries.registry import query, rounded
from clickward.sources.adapters import model_scores, scored

CLASS = ("accuracy", "precision", "recall", "f1", "mcc")
POINTS = sql.points("scores")
AREAS = sql.areas()


def _sql(select: str, *parts: str) -> str:
    return sql.with_(sql.SCORED_ROWS, *parts, select=select)


@query(
    "ensemble_mean",
    sql.with_(
        sql.MODEL_ROWS,
        select="SELECT split, id, round(avg(p), 6) AS p FROM model_scores GROUP BY split, id",
    ),
)
def ensemble(spark, sf_dir):
    return ensemble_mean(model_scores(spark, sf_dir), ("split", "id")).select("split", "id", *rounded("p"))


@query(
    "confusion",
    _sql(
        "SELECT tn, fp, fn, tp, "
        + ", ".join(f"round({c} / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS {c}_share" for c in ("tn", "fp", "fn", "tp"))
        + " FROM counts",
        sql.confusion("scores"),
    ),
)
def confusion(spark, sf_dir):
    return ops.confusion(scored(spark, sf_dir)).select(
        "tn", "fp", "fn", "tp", *rounded("tn_share", "fp_share", "fn_share", "tp_share")
    )


@query(
    "class_metrics",
    sql.with_(
        sql.MODEL_ROWS,
        sql.confusion("model_scores", "model, split"),
        select=f"SELECT model, split, {sql.metric_columns()} FROM counts",
    ),
)
def class_metrics(spark, sf_dir):
    return ops.class_metrics(model_scores(spark, sf_dir), ("model", "split")).select("model", "split", *rounded(*CLASS))


@query("roc_auc", _sql("SELECT round(roc_auc, 6) AS roc_auc FROM areas", POINTS, AREAS))
def roc_auc(spark, sf_dir):
    return ops.roc_auc(scored(spark, sf_dir)).select(*rounded("roc_auc"))


@query("pr_auc", _sql("SELECT round(pr_auc, 6) AS pr_auc FROM areas", POINTS, AREAS))
def pr_auc(spark, sf_dir):
    return ops.pr_auc(scored(spark, sf_dir)).select(*rounded("pr_auc"))


@query(
    "roc_points",
    _sql(
        "SELECT p AS threshold, round(fp / CAST(all_neg AS DOUBLE), 6) AS fpr, round(tp / CAST(all_pos AS DOUBLE), 6) AS tpr FROM points",
        POINTS,
    ),
)
def roc_points(spark, sf_dir):
    return ops.roc_points(scored(spark, sf_dir)).select("threshold", *rounded("fpr", "tpr"))


@query(
    "pr_points",
    _sql(
        'SELECT p AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS "precision", round(tp / CAST(all_pos AS DOUBLE), 6) AS recall, round(all_pos / CAST(all_pos + all_neg AS DOUBLE), 6) AS prevalence FROM points',
        POINTS,
    ),
)
def pr_points(spark, sf_dir):
    return ops.pr_points(scored(spark, sf_dir)).select("threshold", *rounded("precision", "recall", "prevalence"))


_SWEEP = f"""
grid AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in ops.THRESHOLDS)}]) AS threshold),
sweep_counts AS (
  SELECT threshold, count(*) FILTER (WHERE p < threshold AND y = 0) AS tn, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp,
    count(*) FILTER (WHERE p < threshold AND y = 1) AS fn, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp
  FROM scores, grid GROUP BY threshold),
sweep AS (
  SELECT threshold, {sql.PRECISION} AS prec, {sql.RECALL} AS recall, {sql.F1} AS f1, {sql.MCC} AS mcc, tp + fp AS positives_predicted FROM sweep_counts)
"""
_SWEEP_COLUMNS = 'threshold, round(prec, 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(mcc, 6) AS mcc, positives_predicted'
SWEEP = ("precision", "recall", "f1", "mcc")


@query("threshold_sweep", _sql(f"SELECT {_SWEEP_COLUMNS} FROM sweep", _SWEEP))
def threshold_sweep(spark, sf_dir):
    return ops.threshold_sweep(scored(spark, sf_dir)).select("threshold", *rounded(*SWEEP), "positives_predicted")


@query(
    "threshold_select",
    _sql(f"SELECT {_SWEEP_COLUMNS} FROM sweep ORDER BY sweep.f1 DESC, sweep.mcc DESC, sweep.recall DESC, threshold LIMIT 1", _SWEEP),
)
def threshold_select(spark, sf_dir):
    best = ops.threshold_select(ops.threshold_sweep(scored(spark, sf_dir)))
    return best.select("threshold", *rounded(*SWEEP), "positives_predicted")


@query(
    "topk_metrics",
    _sql(
        """
SELECT CAST(k AS BIGINT) AS k, hits, round(hits / CAST(k AS DOUBLE), 6) AS precision_at_k, round(hits / CAST(pos AS DOUBLE), 6) AS recall_at_k,
  round(hits / CAST(k AS DOUBLE) / (pos / CAST(n AS DOUBLE)), 6) AS lift_at_k, round(hits / CAST(pos AS DOUBLE), 6) AS topk_capture,
  round(pos / CAST(n AS DOUBLE), 6) AS prevalence
FROM (
  SELECT least(k, n) AS k, n, pos, (SELECT count(*) FROM ranked WHERE y = 1 AND place <= k) AS hits
  FROM (SELECT unnest([50, 100, 500, 1000]) AS k), (SELECT count(*) AS n, sum(y) AS pos FROM scores))
""",
        "ranked AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS place FROM scores)",
    ),
)
def topk_metrics(spark, sf_dir):
    return ops.topk_metrics(scored(spark, sf_dir)).select(
        "k", "hits", *rounded("precision_at_k", "recall_at_k", "lift_at_k", "topk_capture", "prevalence")
    )


@query(
    "top_decile",
    _sql(
        """
SELECT CAST(cut AS BIGINT) AS top_decile_k, count(*) FILTER (WHERE y = 1 AND place <= cut) AS hits,
  round(count(*) FILTER (WHERE y = 1 AND place <= cut) / CAST(sum(y) AS DOUBLE), 6) AS top_decile_capture
FROM (
  SELECT y, row_number() OVER (ORDER BY p DESC, id) AS place, greatest(1, round_even(count(*) OVER () * 0.1::DOUBLE, 0)) AS cut FROM scores)
GROUP BY cut
"""
    ),
)
def top_decile(spark, sf_dir):
    return ops.top_decile(scored(spark, sf_dir)).select("top_decile_k", "hits", *rounded("top_decile_capture"))


@query(
    "calibration_bins",
    _sql(
        """
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM (
  SELECT p, y, len(list_filter(e, lambda c: c < p)) AS bin FROM scores, (
    SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scores))
GROUP BY bin
"""
    ),
)
def calibration_bins(spark, sf_dir):
    return ops.calibration_bins(scored(spark, sf_dir)).select("bin", "n", *rounded("mean_p", "observed"))


@query("brier", _sql("SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM scores"))
def brier(spark, sf_dir):
    return ops.brier(scored(spark, sf_dir)).select(*rounded("brier"))


@query(
    "prob_histogram",
    _sql(
        """
SELECT y, bin, n, round(n * 29.0::DOUBLE / sum(n) OVER (PARTITION BY y), 6) AS density FROM (
  SELECT y, CAST(least(floor(p * 29), 28) AS INTEGER) AS bin, count(*) AS n FROM scores GROUP BY 1, 2)
"""
    ),
)
def prob_histogram(spark, sf_dir):
    return ops.prob_histogram(scored(spark, sf_dir)).select("y", "bin", "n", *rounded("density"))


@query("all_negative_accuracy", _sql("SELECT round(avg(1 - y), 6) AS all_negative_accuracy FROM scores"))
def all_negative_accuracy(spark, sf_dir):
    return ops.all_negative_accuracy(scored(spark, sf_dir)).select(*rounded("all_negative_accuracy"))


# Per model: all metrics on test, and the three ranking metrics on validation.
_BOARD = (
    sql.MODEL_ROWS,
    sql.points("model_scores", "model, split"),
    sql.areas("points", "model, split"),
    sql.confusion("model_scores", "model, split"),
    f"""
all_metrics AS (
  SELECT c.model, c.split, tn, fp, fn, tp, {sql.ACCURACY} AS accuracy, {sql.PRECISION} AS prec, {sql.RECALL} AS recall,
    {sql.F1} AS f1, {sql.MCC} AS mcc, roc_auc, pr_auc
  FROM counts c JOIN areas a ON c.model = a.model AND c.split = a.split)
""",
    """
board AS (
  SELECT t.*, v.pr_auc AS val_pr_auc, v.mcc AS val_mcc, v.f1 AS val_f1
  FROM all_metrics t JOIN all_metrics v ON t.model = v.model AND t.split = 'test' AND v.split = 'val')
""",
)
BOARD = ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc", "val_pr_auc", "val_mcc", "val_f1")
_BOARD_SQL = ", ".join(
    f'round({"prec" if c == "precision" else c}, 6) AS "{c}"' for c in BOARD
)


def _board(spark, sf_dir):
    metrics = ops.model_metrics(model_scores(spark, sf_dir), ("model", "split"))
    val = metrics.where("split = 'val'").select(
        "model", *[F.col(c).alias(f"val_{c}") for c in ("pr_auc", "mcc", "f1")]
    )
    return metrics.where("split = 'test'").drop("split").join(val, "model")


@query(
    "leaderboard",
    sql.with_(
        *_BOARD,
        select=f"SELECT model, tn, fp, fn, tp, {_BOARD_SQL}, CAST(row_number() OVER (ORDER BY board.val_pr_auc DESC, board.val_mcc DESC, board.val_f1 DESC, model) AS INTEGER) AS place FROM board",
    ),
)
def leaderboard(spark, sf_dir):
    board = ops.leaderboard(_board(spark, sf_dir))
    return board.select("model", "tn", "fp", "fn", "tp", *rounded(*BOARD), "place")


@query(
    "track_union",
    sql.with_(
        *_BOARD,
        select=f"""
SELECT 'production_safe' AS track_mode, model, {_BOARD_SQL} FROM board WHERE model <> 'by_mix'
UNION ALL SELECT 'benchmark_transductive', model, {_BOARD_SQL} FROM board
""",
    ),
)
def track_union(spark, sf_dir):
    board = _board(spark, sf_dir).select("model", *rounded(*BOARD))
    causal = board.where("model <> 'by_mix'").withColumn("track_mode", F.lit("production_safe"))
    return ops.track_union(causal, board.withColumn("track_mode", F.lit("benchmark_transductive")))


@query(
    "metrics_long",
    sql.with_(
        *_BOARD,
        select=" UNION ALL ".join(
            f"SELECT model, '{c}' AS metric, round({'prec' if c == 'precision' else c}, 6) AS score FROM board"
            for c in BOARD[:7]
        ),
    ),
)
def metrics_long(spark, sf_dir):
    return ops.metrics_long(_board(spark, sf_dir)).select("model", "metric", *rounded("score"))


@query(
    "metric_parity",
    sql.with_(
        *_BOARD,
        """
logged AS (
  SELECT board.model, board.pr_auc, board.f1, board.mcc, board.prec, board.recall + CASE WHEN model = 'by_k' THEN 0.25 ELSE 0 END AS recall FROM board
  UNION ALL SELECT 'absent', 0.5, 0.5, 0.5, 0.5, 0.5),
compared AS (
  SELECT l.model, greatest(abs(l.pr_auc - b.pr_auc), abs(l.f1 - b.f1), abs(l.mcc - b.mcc), abs(l.prec - b.prec), abs(l.recall - b.recall)) AS delta,
    b.model IS NOT NULL AS found
  FROM logged l LEFT JOIN board b USING (model))
""",
        select="""
SELECT model, CASE WHEN found THEN round(delta, 6) END AS max_abs_delta, COALESCE(found AND delta <= 1e-9, false) AS parity_pass FROM compared
""",
    ),
)
def metric_parity(spark, sf_dir):
    """One model's logged recall is off by a quarter, another has no predictions: both must show."""
    scores = model_scores(spark, sf_dir).where("split = 'test'")
    off = F.when(F.col("model") == "by_k", 0.25).otherwise(0.0)
    logged = ops.model_metrics(scores, ("model",)).withColumn("recall", F.col("recall") + off)
    absent = logged.limit(1).withColumn("model", F.lit("absent"))
    parity = ops.metric_parity(logged.unionByName(absent), scores, ("model",))
    return parity.select("model", *rounded("max_abs_delta"), "parity_pass")
