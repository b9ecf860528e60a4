"""Fits have no SQL; their invariants hold, and a whole batch run ends in passed checks."""

from __future__ import annotations

from datetime import datetime

import pytest
from paths import SMALL_DIR
from pyspark.sql import functions as F

from clickward.operators import evaluate, models
from clickward.operators.clean import safe_features
from clickward.operators.features import Track
from clickward.plans import modelling
from clickward.plans.batch import run_batch
from clickward.session import compiled_stages, scratch_path
from clickward.streaming.trust_stream import score_batch

# A run of seconds; the registered queries run the defaults.
TINY = models.ModelConfig(
    bag_count=2,
    neg_pos_ratio=2,
    rounds=3,
    num_leaves=8,
    learning_rate=0.1,
    min_val_positives=5,
    min_test_positives=5,
    logistic_iterations=20,
    forest_trees=5,
    forest_depth=6,
    boosted_rounds=3,
    boosted_depth=4,
)


def clicks_with_signal(spark, rows):
    """Clicks every 13 seconds; the channel says a lot about the label."""
    drawn = F.pmod(F.xxhash64("id"), F.lit(100))
    channel = 100 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))
    likely = F.when(channel % 4 == 0, 70).otherwise(4)
    label = (drawn < likely).cast("int")
    at = F.timestamp_seconds(F.lit(1_509_926_400) + F.col("id") * 13)
    return spark.range(rows).select(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("click_time"),
        (10_000 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(800))).alias("ip"),
        (1 + F.col("id") % 24).alias("app"),
        (1 + F.col("id") % 5).alias("device"),
        (9 + F.col("id") % 18).alias("os"),
        channel.alias("channel"),
        (1 - label).alias("is_fraud"),
        label.alias("is_attributed"),
        F.lit("").alias("attributed_time"),
    )


@pytest.fixture(scope="module")
def batch(spark):
    source = scratch_path(spark, "clicks-csv")
    clicks_with_signal(spark, 3000).coalesce(1).write.option("header", True).csv(source)
    return run_batch(spark, source, scratch_path(spark, "run"), TINY, as_of=datetime(2018, 1, 1))


def test_probabilities_and_predictions(batch):
    result = batch["tracks"][Track.CAUSAL]
    predictions = result.fitted.predictions
    assert predictions.where("p < 0 or p > 1 or p is null").count() == 0
    per = predictions.groupBy("model", "variant", "split").count().collect()
    assert {(r["model"], r["variant"]) for r in per} == {
        ("LogisticRegression", "uncalibrated"),
        ("RandomForest", "uncalibrated"),
        ("BoostedTrees", "uncalibrated"),
        ("BaggedBoosting", "uncalibrated"),
        ("BaggedBoosting", "calibrated"),
    }
    sizes = {r["split"]: r["count"] for r in per}
    assert sizes == {s: result.matrix.part(s).count() for s in ("val", "test")}


def test_no_forbidden_or_whole_frame_feature(batch):
    features = batch["tracks"][Track.CAUSAL].matrix.features
    assert safe_features(features, "is_attributed") == list(features)
    assert not set(features) & set(modelling.WHOLE_FRAME)
    assert "te_ip_app" in features and "ip_unique_app_count" in features


def test_checks_and_tables(spark, batch):
    result = batch["tracks"][Track.CAUSAL]
    checks = {r["check_name"]: r["passed"] for r in modelling.acceptance_checks(result).collect()}
    # How well a tiny forest ranks against the others is not an invariant.
    checks.pop("no_pr_auc_regression_vs_forest")
    assert all(checks.values()), checks
    assert tuple(batch["verification"].first()) == (True, 1, None, None)
    assert batch["manifest"].count() >= 1
    paths = batch["paths"]
    curated = spark.read.parquet(paths.curated)
    assert curated.count() == spark.read.parquet(paths.scored).where("is_valid_record").count()
    for name in ("validation_report", "drift", "models/all", "thresholds/production_safe", "topk/production_safe"):
        assert spark.read.option("header", True).csv(f"{paths.metrics(name)}/csv").count() > 0
    assert spark.read.json(f"{paths.metrics('acceptance/production_safe')}/json").count() == len(checks) + 1


def test_learns_more_than_chance_on_train(batch):
    result = batch["tracks"][Track.CAUSAL]
    matrix = result.matrix
    model, _ = result.fitted.singles["BoostedTrees"]
    train = models.predict(model, matrix.part("train"), matrix.features).select(
        F.col("event_id").alias("id"), F.col("is_attributed").alias("y"), "p"
    )
    assert evaluate.pr_auc(train).first()[0] > train.agg(F.avg("y")).first()[0]


def test_calibration_keeps_the_ranking(batch):
    result = batch["tracks"][Track.CAUSAL]
    assert result.fitted.calibration.slope > 0
    board = {r["variant"]: r["roc_auc"] for r in result.board.collect() if r["model"] == "BaggedBoosting"}
    assert abs(board["calibrated"] - board["uncalibrated"]) < 1e-9


def test_bag_manifest(batch):
    rows = batch["tracks"][Track.CAUSAL].fitted.bagging.manifest.collect()
    assert [r["seed"] for r in rows] == [TINY.seed, TINY.seed + 1]
    assert all(r["negative_count"] <= TINY.neg_pos_ratio * r["positive_count"] for r in rows)
    overlap = modelling.bag_report(batch["tracks"][Track.CAUSAL]).first()
    assert 0.0 <= overlap["jaccard"] < 1.0


def test_importances_are_ranked(batch):
    result = batch["tracks"][Track.CAUSAL]
    for name, label in (("RandomForest", "importance"), ("LogisticRegression", "abs(coefficient)")):
        model, _ = result.fitted.singles[name]
        rows = models.importance_table(model, result.matrix.frame, result.matrix.features).collect()
        weights = [r["importance"] for r in rows]
        assert len(rows) == 15 and weights == sorted(weights, reverse=True)
        assert {r["metric_label"] for r in rows} == {label}
        assert all(r["feature"] in result.matrix.features for r in rows)


def test_same_seed_same_fit(batch):
    matrix = batch["tracks"][Track.CAUSAL].matrix
    train = matrix.part("train")
    pos, neg = models.class_counts(train, "is_attributed")

    def fit():
        weight = models.positive_weight("is_attributed", pos, neg)
        model = models.fit(train, matrix.features, "is_attributed", models.boosted("is_attributed", TINY), weight)
        return sorted(r["p"] for r in models.predict(model, matrix.part("test"), matrix.features).select("p").collect())

    assert fit() == fit()


def test_guards(spark):
    with pytest.raises(ValueError):
        TINY.with_(enable_next_click=True).check()
    with pytest.raises(ValueError):
        TINY.with_(imbalance_strategy="none").check()
    with pytest.raises(ValueError):
        run_batch(spark, "none", "none", TINY.with_(target="is_fraud"))
    with pytest.raises(ValueError):
        run_batch(spark, "none", "none", TINY.with_(target="clicks"))


def test_gaps_are_no_fraud(batch):
    result = batch["tracks"][Track.CAUSAL]
    model, _ = result.fitted.singles["LogisticRegression"]
    rows = result.matrix.part("test").withColumn("te_ip_app", F.lit(None).cast("double"))
    scored = score_batch(rows, model)
    assert scored.where("pred_fraud_proba is null or isnan(pred_fraud_proba)").count() == 0
    assert scored.where("te_ip_app is not null or pred_error is not null").count() == 0


def test_fit_rows_bound_the_fit_only(batch):
    matrix = batch["tracks"][Track.CAUSAL].matrix
    small = modelling.fit_models(modelling.replace(matrix, config=TINY.with_(max_fit_rows=300)), "baseline")
    held = matrix.part("val").count() + matrix.part("test").count()
    assert {r["count"] for r in small.predictions.groupBy("model").count().collect()} == {held}


def test_wide_stages_stay_within_what_the_jvm_compiles(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    try:
        spark.conf.unset(limit)
        compiled_stages(spark)
        assert spark.conf.get(limit) == "8000"
        spark.conf.set(limit, "4000")
        compiled_stages(spark)
        assert spark.conf.get(limit) == "4000"
    finally:
        spark.conf.unset(limit)
