"""Classifiers: preprocessing, fits, bags, calibration, importances. Linear models are MLlib's, trees are `trees`.

Frames come in with feature columns, an integer target and a row id. Training
runs on the executors; only fitted models are on the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickward.operators.features import Track
from clickward.operators.sampling import bag_flags
from clickward.operators.trees import Ensemble, Growth, boosted_trees, grown_forest

Model = PipelineModel | Ensemble


@dataclass(frozen=True)
class ModelConfig:
    """Settings of a model run."""

    track: Track = Track.CAUSAL
    target: str = "is_attributed"
    bag_count: int = 5
    neg_pos_ratio: int = 200
    learning_rate: float = 0.05
    num_leaves: int = 64
    rounds: int = 600
    calibration_method: str = "platt"
    imbalance_strategy: str = "subsampling_only"
    min_val_positives: int = 100
    min_test_positives: int = 100
    row_cap: int | None = None
    row_cap_step: int = 50_000
    folds: int = 5
    alpha: float = 20.0
    enable_next_click: bool = False
    seed: int = 42
    logistic_iterations: int = 700
    forest_trees: int = 260
    forest_depth: int = 12
    boosted_rounds: int = 260
    boosted_depth: int = 6
    # Rounds without a lower validation loss after which a bag stops.
    patience: int = 50
    # Bounds the rows that the models are fitted on, never those scored or evaluated.
    max_fit_rows: int | None = None

    def check(self) -> "ModelConfig":
        if self.calibration_method != "platt":
            raise ValueError("calibration_method has one value: platt")
        if self.imbalance_strategy not in ("subsampling_only", "subsampling_plus_weighting"):
            raise ValueError("imbalance_strategy is subsampling_only or subsampling_plus_weighting")
        if Track(self.track) is Track.CAUSAL and self.enable_next_click:
            raise ValueError("The causal track cannot look at next clicks: unset enable_next_click")
        if self.min_val_positives <= 0 or self.min_test_positives <= 0 or self.row_cap_step <= 0:
            raise ValueError("min_val_positives, min_test_positives and row_cap_step start at 1")
        return self

    def with_(self, **changes) -> "ModelConfig":
        return replace(self, **changes)


def split_types(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other feature columns. Times are left out: they would become
    one category per instant."""
    numeric, other = [], []
    for f in df.schema.fields:
        if f.name not in features or isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            continue
        (numeric if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else other).append(f.name)
    return numeric, other


def preprocess_stages(df: DataFrame, features: Sequence[str]) -> list:
    """Standardised numbers and one-hot categories; unknown categories get their own slot."""
    numeric, other = split_types(df, features)
    stages, parts = [], []
    if numeric:
        stages += [
            VectorAssembler(inputCols=numeric, outputCol="_raw_numbers", handleInvalid="keep"),
            StandardScaler(inputCol="_raw_numbers", outputCol="_numbers", withMean=True, withStd=True),
        ]
        parts.append("_numbers")
    if other:
        codes, hot = [f"_code_{c}" for c in other], [f"_hot_{c}" for c in other]
        stages += [
            StringIndexer(inputCols=other, outputCols=codes, handleInvalid="keep"),
            OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False),
        ]
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def ready_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric features without gaps: NULL, NaN and infinities become -1."""
    numeric, _ = split_types(df, features)

    def clean(name: str) -> Column:
        value = F.col(name).cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        return F.when(finite, value).otherwise(F.lit(-1.0))

    return df.withColumns({c: clean(c) for c in numeric})


def model_inputs(model: PipelineModel) -> list[str]:
    """The columns a fitted pipeline reads from a frame."""
    stages = getattr(model, "stages", [])
    made = {s.getOutputCol() for s in stages if hasattr(s, "getOutputCol") and s.isSet("outputCol")}
    made |= {c for s in stages if hasattr(s, "getOutputCols") and s.isSet("outputCols") for c in s.getOutputCols()}
    read = [c for s in stages if hasattr(s, "getInputCols") and s.isSet("inputCols") for c in s.getInputCols()]
    return [c for c in dict.fromkeys(read) if c not in made]


def class_counts(df: DataFrame, target: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")).first()
    return row["pos"], row["neg"]


def balanced_weight(target: str, pos: int, neg: int) -> Column:
    """n / (2 * rows of the class)."""
    n = pos + neg
    return F.when(F.col(target) == 1, n / (2.0 * max(1, pos))).otherwise(n / (2.0 * max(1, neg)))


def positive_weight(target: str, pos: int, neg: int) -> Column:
    return F.when(F.col(target) == 1, max(1.0, neg / max(1, pos))).otherwise(1.0)


def logistic(target: str, rows: int, iterations: int) -> LogisticRegression:
    """Ridge of strength 1 in total. The inputs are standardised already."""
    return LogisticRegression(
        labelCol=target, weightCol="_weight", maxIter=iterations, regParam=1.0 / max(1, rows), standardization=False
    )


def boosted(target: str, config: ModelConfig) -> GBTClassifier:
    """MLlib's boosting, for pipelines that are stored as such."""
    return GBTClassifier(
        labelCol=target,
        weightCol="_weight",
        maxIter=config.boosted_rounds,
        maxDepth=config.boosted_depth,
        stepSize=0.08,
        subsamplingRate=0.85,
        featureSubsetStrategy="0.8",
        seed=config.seed,
    )


def fit(df: DataFrame, features: Sequence[str], target: str, estimator, weight: Column) -> PipelineModel:
    """Fit preprocessing and one estimator on a training frame."""
    ready = ready_numbers(df, features).withColumn("_weight", weight)
    return Pipeline(stages=[*preprocess_stages(ready, features), estimator]).fit(ready)


def positive_probability(transformed: DataFrame, out: str) -> DataFrame:
    return transformed.withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))


def predict(model: Model, df: DataFrame, features: Sequence[str], out: str = "p") -> DataFrame:
    """The frame with the probability of class 1."""
    if isinstance(model, Ensemble):
        return model.transform(df, out)
    scored = positive_probability(model.transform(ready_numbers(df, features)), out)
    return scored.select(*[F.col(c) for c in df.columns], out)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    if isinstance(model, Ensemble):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def fit_logistic(df: DataFrame, features: Sequence[str], config: ModelConfig) -> PipelineModel:
    """Logistic regression with balanced classes."""
    pos, neg = class_counts(df, config.target)
    estimator = logistic(config.target, pos + neg, config.logistic_iterations)
    return fit(df, features, config.target, estimator, balanced_weight(config.target, pos, neg))


def fit_forest(df: DataFrame, features: Sequence[str], config: ModelConfig, tie: str = "event_id") -> Ensemble:
    """A forest with classes balanced inside every bootstrap."""
    growth = Growth(depth=config.forest_depth)
    return grown_forest(df, features, config.target, tie, config.forest_trees, growth, config.seed)


def fit_boosted(df: DataFrame, features: Sequence[str], config: ModelConfig, tie: str = "event_id") -> Ensemble:
    """Trees of bounded depth, positives weighing as much as the negatives."""
    pos, neg = class_counts(df, config.target)
    growth = Growth(depth=config.boosted_depth, min_hessian=1.0, ridge=1.0, row_share=0.85, column_share=0.8)
    weight = positive_weight(config.target, pos, neg)
    return boosted_trees(
        df, features, config.target, tie, [weight], [config.seed], growth, config.boosted_rounds, rate=0.08
    )


def baseline_models(df: DataFrame, features: Sequence[str], config: ModelConfig) -> dict[str, tuple[Model, float]]:
    """The three single models and their training seconds."""
    fits = {"LogisticRegression": fit_logistic, "RandomForest": fit_forest, "BoostedTrees": fit_boosted}
    out = {}
    for name, fitted in fits.items():
        start = time.perf_counter()
        out[name] = (fitted(df, features, config), time.perf_counter() - start)
    return out


@dataclass(frozen=True)
class Bagging:
    """Trees of all bags, the rows of each bag, and the table describing them."""

    model: Ensemble
    bags: tuple[DataFrame, ...] = field(repr=False)
    manifest: DataFrame = field(repr=False)
    seconds: float = 0.0

    def predict(self, df: DataFrame, features: Sequence[str], out: str = "p") -> DataFrame:
        """Mean probability over the bags, in one pass over the frame."""
        return self.model.transform(df, out)


def bagged_boosting(
    train: DataFrame, val: DataFrame, features: Sequence[str], config: ModelConfig, tie: str = "event_id"
) -> Bagging:
    """Boosted trees grown by leaves on seeded bags, each stopped early on the validation part.

    All bags grow in the same passes over one table: a row has a weight per bag.
    """
    target, start = config.target, time.perf_counter()
    seeds = [config.seed + i for i in range(max(1, config.bag_count))]
    flags = bag_flags(train, target, config.neg_pos_ratio, seeds, tie)
    sizes = train.agg(
        *[F.count_if(f & (F.col(target) == c)).alias(f"n{c}_{i}") for i, f in enumerate(flags) for c in (0, 1)]
    ).first()
    weights = []
    for i, flag in enumerate(flags):
        weight = F.lit(1.0)
        if config.imbalance_strategy == "subsampling_plus_weighting":
            weight = positive_weight(target, sizes[f"n1_{i}"], sizes[f"n0_{i}"])
        weights.append(F.when(flag, weight))
    both = train.withColumn("_is_val", F.lit(False)).unionByName(val.withColumn("_is_val", F.lit(True)))
    growth = Growth(
        leaves=max(2, config.num_leaves), min_rows=20, min_hessian=1e-3, row_share=0.9, column_share=0.8
    )
    model = boosted_trees(
        both,
        features,
        target,
        tie,
        weights,
        seeds,
        growth,
        config.rounds,
        config.learning_rate,
        held_out=F.col("_is_val"),
        patience=config.patience,
    )
    rows = [
        (i + 1, seed, sizes[f"n1_{i}"] + sizes[f"n0_{i}"], sizes[f"n1_{i}"], sizes[f"n0_{i}"], len(model.trees[i]), model.rounds[i])
        for i, seed in enumerate(seeds)
    ]
    manifest = train.sparkSession.createDataFrame(
        rows,
        "bag_index int, seed int, sample_size bigint, positive_count bigint, negative_count bigint, trees int, rounds int",
    )
    bags = tuple(train.where(f) for f in flags)
    return Bagging(model, bags, manifest, (time.perf_counter() - start) / len(seeds))


@dataclass(frozen=True)
class Platt:
    """A one-feature logistic map of scores."""

    intercept: float
    slope: float

    def apply(self, df: DataFrame, p: str = "p") -> DataFrame:
        z = F.lit(self.intercept) + F.lit(self.slope) * F.col(p)
        return df.withColumn(p, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def platt_calibration(val: DataFrame, target: str = "y", p: str = "p") -> Platt:
    """Fit the map on validation scores, with ridge of strength 1 in total."""
    points = VectorAssembler(inputCols=[p], outputCol="_score").transform(val.select(target, p))
    model: LogisticRegressionModel = LogisticRegression(
        featuresCol="_score", labelCol=target, maxIter=1000, regParam=1.0 / max(1, val.count()), standardization=False
    ).fit(points)
    return Platt(float(model.intercept), float(model.coefficients[0]))


def feature_importance(
    model: Model, transformed_schema: T.StructType | None = None, top: int = 15
) -> list[tuple[str, float, str]]:
    """The heaviest features of a fitted model, by share of the trees' gains or absolute coefficient."""
    if isinstance(model, Ensemble):
        ranked = sorted(zip(model.binning.features, model.importances), key=lambda r: (-r[1], r[0]))
        return [(name, float(weight), "importance") for name, weight in ranked[:top]]
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        weights, label = last.featureImportances.toArray(), "importance"
    else:
        weights, label = abs(last.coefficients.toArray()), "abs(coefficient)"
    attributes = transformed_schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: a.get("name") for group in attributes.values() for a in group}
    numeric = next((s.getInputCols() for s in model.stages if getattr(s, "getOutputCol", str)() == "_raw_numbers"), [])

    def name(i: int) -> str:
        return numeric[i] if i < len(numeric) else (named.get(i) or f"feature_{i}").removeprefix("_hot_")

    ranked = sorted(((name(i), float(w), label) for i, w in enumerate(weights)), key=lambda r: (-r[1], r[0]))
    return ranked[:top]


def importance_table(model: Model, df: DataFrame, features: Sequence[str], top: int = 15) -> DataFrame:
    schema = None if isinstance(model, Ensemble) else model.transform(ready_numbers(df, features)).schema
    return df.sparkSession.createDataFrame(
        feature_importance(model, schema, top), "feature string, importance double, metric_label string"
    )


