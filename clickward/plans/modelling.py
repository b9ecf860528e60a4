"""The modelling stage: feature matrix, fits, evaluation and acceptance checks."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.operators import evaluate, models, splits
from clickward.operators.clean import clean_target, click_unix, prepare_events, require_two_classes, safe_features
from clickward.operators.encoding import EncodingInfo, rate_features
from clickward.operators.features import BY_VALUE, COUNT_FAMILIES, Track, count_features, delta_features
from clickward.operators.models import Bagging, Model, ModelConfig, Platt
from clickward.operators.ordering import time_order
from clickward.operators.sampling import bag_overlap, stratified_sample
from clickward.session import SkewPolicy, materialize

# Whole-frame features of the trust stage: they look at later rows.
WHOLE_FRAME = ("clicks_per_ip", "unique_channels_per_ip", "app_channel_freq", "clicks_per_ip_per_hour")
BOOKKEEPING = ("event_id", "idx", "split", "strategy")


@dataclass(frozen=True)
class Matrix:
    """A written feature frame and what it holds."""

    frame: DataFrame = field(repr=False)
    features: tuple[str, ...]
    config: ModelConfig
    encoding: EncodingInfo
    attempts: DataFrame = field(repr=False)

    def part(self, split: str) -> DataFrame:
        return self.frame.where(F.col("split") == split)


def feature_matrix(curated: DataFrame, config: ModelConfig, policy: SkewPolicy | None = None) -> Matrix:
    """Curated rows to a matrix with splits, counts, deltas and encodings.

    On the causal track features that look at the whole frame are left out. The
    frame is written with its positions, and with all features for the fits;
    between the two it moves once, by ip, unless an ip is hot.
    """
    config = config.check()
    track, target, order = Track(config.track), config.target, time_order()
    # Positions count from the first row, and so do counts of earlier rows in any head window.
    counts = {n: COUNT_FAMILIES[n] for n in BY_VALUE} if track is Track.CAUSAL else {}
    rows = splits.placed_rows(clean_target(prepare_events(curated), target), order, policy, counts)
    require_two_classes(rows, target)
    support = {"min_val": config.min_val_positives, "min_test": config.min_test_positives}
    attempts = materialize(
        splits.window_attempts(
            rows, target, config.row_cap, config.row_cap_step, **support, track=track, order=order, policy=policy
        ),
        "attempts",
    )
    chosen = splits.select_window(rows, target, attempts, order, policy)
    if track is Track.CAUSAL:
        parted = splits.temporal_split(chosen, rows=attempts.where("selected").first()["cap"])
    else:
        parted = splits.competition_split(chosen, order=order, policy=policy)
    placed = count_features(parted, track, order, policy)
    placed = delta_features(placed, track, config.enable_next_click, order, policy, sizes_of=parted)
    base = placed.select(*[c for c in placed.columns if c not in ("split", "strategy")], "split", "strategy")
    encoded, info = rate_features(
        click_unix(base), target, config.folds, config.alpha, order, policy, history_of=parted
    )
    frame = materialize(encoded, "matrix")
    left_out = {*BOOKKEEPING, *(WHOLE_FRAME if track is Track.CAUSAL else ())}
    used = [c for c in safe_features(frame.columns, target) if c not in left_out and not c.startswith("rule_")]
    numeric, other = models.split_types(frame, used)
    return Matrix(frame, tuple([*numeric, *other]), config, info, attempts)


@dataclass(frozen=True)
class Fitted:
    """Models of a run and their written predictions (model, variant, split, event_id, y, p)."""

    singles: dict[str, tuple[Model, float]]
    bagging: Bagging | None
    calibration: Platt | None
    predictions: DataFrame = field(repr=False)
    seconds: float = 0.0


def fit_models(matrix: Matrix, family: str = "all", bagging: Bagging | None = None) -> Fitted:
    """Fit the single models, the bags, or both; score validation and test rows.

    `bagging` is an earlier fit of the same matrix and settings, to be used again.
    """
    if family not in ("baseline", "bagging", "all"):
        raise ValueError("family must be one of: baseline, bagging, all")
    start = time.perf_counter()
    config, features, target = matrix.config, matrix.features, matrix.config.target
    train, val = matrix.part("train"), matrix.part("val")
    if config.max_fit_rows is not None:
        train = materialize(stratified_sample(train, config.max_fit_rows, target, config.seed), "fit-rows")
    holdout = matrix.frame.where(F.col("split").isin("val", "test"))
    singles = models.baseline_models(train, features, config) if family != "bagging" else {}
    tables = [
        _predictions(models.predict(model, holdout, features), target, name, "uncalibrated")
        for name, (model, _) in singles.items()
    ]
    calibration = None
    if family == "baseline":
        bagging = None
    else:
        bagging = bagging or models.bagged_boosting(train, val, features, config)
        raw = materialize(
            _predictions(bagging.predict(holdout, features), target, "BaggedBoosting", "uncalibrated"), "bagged"
        )
        calibration = models.platt_calibration(raw.where("split = 'val'"))
        tables += [raw, calibration.apply(raw).withColumn("variant", F.lit("calibrated"))]
    table = materialize(evaluate.track_union(*tables), "predictions")
    return Fitted(singles, bagging, calibration, table, time.perf_counter() - start)


def _predictions(scored: DataFrame, target: str, model: str, variant: str) -> DataFrame:
    return scored.select(
        F.lit(model).alias("model"),
        F.lit(variant).alias("variant"),
        "split",
        F.col("event_id").alias("id"),
        F.col(target).alias("y"),
        "p",
    )


def metric_table(predictions: DataFrame, track: Track, policy: SkewPolicy | None = None) -> DataFrame:
    """One row per model and variant: test metrics, and validation metrics to rank by."""
    by = ("model", "variant")
    metrics = evaluate.model_metrics(predictions, (*by, "split"), policy)
    val = metrics.where("split = 'val'").select(
        *by, *[F.col(c).alias(f"val_{c}") for c in ("pr_auc", "mcc", "f1")]
    )
    return (
        metrics.where("split = 'test'")
        .drop("split")
        .join(val, list(by))
        .withColumns(
            {
                "track_mode": F.lit(Track(track).value),
                "test_pos_support": F.col("tp") + F.col("fn"),
                "test_neg_support": F.col("tn") + F.col("fp"),
            }
        )
    )


@dataclass(frozen=True)
class TrackResult:
    """Everything one track reports, as small written tables."""

    track: Track
    matrix: Matrix
    fitted: Fitted
    board: DataFrame
    best_model: str
    best_variant: str
    threshold: float
    sweep: DataFrame
    topk: DataFrame
    seconds: float

    @property
    def best_test(self) -> DataFrame:
        return _of(self.fitted.predictions, self.best_model, self.best_variant, "test")


def _of(predictions: DataFrame, model: str, variant: str, split: str) -> DataFrame:
    mine = (F.col("model") == model) & (F.col("variant") == variant) & (F.col("split") == split)
    return predictions.where(mine).select("id", "y", "p")


def run_track(
    curated: DataFrame,
    config: ModelConfig,
    family: str = "all",
    policy: SkewPolicy | None = None,
    matrix: Matrix | None = None,
    bagging: Bagging | None = None,
) -> TrackResult:
    """Matrix, fits, leaderboard, threshold and ranking tables of one track.

    A model is ranked by its calibrated variant where it has one. The threshold
    is chosen on validation rows and reported on test rows. A `matrix` of the
    same track can be passed on: it does not depend on the seed. So can bags of the same matrix and seed.
    """
    start = time.perf_counter()
    if matrix is None:
        matrix = feature_matrix(curated, config, policy)
    else:
        matrix = replace(matrix, config=config.check())
    fitted = fit_models(matrix, family, bagging)
    board = materialize(
        evaluate.leaderboard(metric_table(fitted.predictions, config.track, policy), "model", "variant"), "board"
    )
    eligible = (F.col("model") != "BaggedBoosting") | (F.col("variant") == "calibrated")
    best = board.where(eligible).orderBy("place").first()
    model, variant = best["model"], best["variant"]
    chosen = evaluate.threshold_select(
        evaluate.threshold_sweep(_of(fitted.predictions, model, variant, "val"))
    ).first()["threshold"]
    test = _of(fitted.predictions, model, variant, "test")
    labels = {"track_mode": F.lit(config.track.value), "model": F.lit(model), "variant": F.lit(variant)}
    sweep = evaluate.threshold_sweep(test).withColumns({**labels, "selected_threshold": F.lit(chosen)})
    topk = evaluate.topk_metrics(test).withColumns(labels)
    return TrackResult(
        config.track,
        matrix,
        fitted,
        board,
        model,
        variant,
        chosen,
        materialize(sweep, "sweep"),
        materialize(topk, "topk"),
        time.perf_counter() - start,
    )


def stability_runs(spark: SparkSession, results: Sequence[tuple[int, TrackResult]]) -> DataFrame:
    """One row per seed with the ranking metrics of its best model."""
    rows = []
    for seed, result in results:
        best = result.board.where(
            (F.col("model") == result.best_model) & (F.col("variant") == result.best_variant)
        ).first()
        rows.append((seed, result.best_model, result.best_variant, best["val_pr_auc"], best["val_mcc"], best["val_f1"]))
    return spark.createDataFrame(
        rows, "seed int, model string, variant string, val_pr_auc double, val_mcc double, val_f1 double"
    )


def acceptance_checks(result: TrackResult, policy: SkewPolicy | None = None) -> DataFrame:
    """(track_mode, check_name, passed): whether the run can be trusted."""
    frame, config, spark = result.matrix.frame, result.matrix.config, result.board.sparkSession
    overlap = splits.split_overlap(frame).first()
    ordered = splits.temporal_order_check(frame).first()["temporal_order_valid"]
    board = result.board.collect()
    forest = [r["pr_auc"] for r in board if r["model"] == "RandomForest" and r["variant"] == "uncalibrated"]
    leader = min(board, key=lambda r: r["place"])
    parity = evaluate.metric_parity(
        result.board,
        result.fitted.predictions.where("split = 'test'"),
        ("model", "variant"),
        policy,
    ).agg(F.min(F.col("parity_pass")).alias("ok")).first()["ok"]
    spread = result.sweep.agg(F.stddev_pop("f1").alias("f1"), F.stddev_pop("mcc").alias("mcc")).first()
    forbidden = set(result.matrix.features) - set(safe_features(result.matrix.features, config.target))
    checks = {
        "semantics_ok": config.target == "is_attributed",
        "no_split_overlap": all(v == 0 for v in overlap),
        "temporal_order_valid": bool(ordered),
        "forbidden_features_absent": not forbidden,
        "next_click_guard_valid": not (config.enable_next_click and result.track is Track.CAUSAL),
        "track_mode_column_valid": {r["track_mode"] for r in board} == {result.track.value},
        "calibrated_probability_path_valid": result.fitted.bagging is None
        or any(r["variant"] == "calibrated" for r in board),
        "metrics_recompute_parity": bool(parity),
        "no_pr_auc_regression_vs_forest": not forest or leader["pr_auc"] >= forest[0],
        "topk_outputs_present": result.topk.count() > 0,
        "threshold_curve_non_flat": (spread["f1"] or 0.0) > 0.0 or (spread["mcc"] or 0.0) > 0.0,
    }
    return spark.createDataFrame(
        [(result.track.value, name, bool(ok)) for name, ok in checks.items()],
        "track_mode string, check_name string, passed boolean",
    )


def bag_report(result: TrackResult) -> DataFrame:
    """Overlap of the bags' negatives."""
    return bag_overlap(list(result.fitted.bagging.bags), result.matrix.config.target)
