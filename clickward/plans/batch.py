"""The whole batch run: trust stage, modelling per track, audit and provenance."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.operators import evaluate
from clickward.operators.features import Track
from clickward.operators.models import ModelConfig, save_model
from clickward.operators.ordering import time_order
from clickward.operators.profile import class_counts, drift_long, drift_psi_kl, score_distribution
from clickward.operators.rules import group_size_bounds, validation_report
from clickward.operators.clean import time_parts
from clickward.plans.modelling import TrackResult, acceptance_checks, run_track, stability_runs
from clickward.plans.trust import stored_baseline, trust_frames, typed_once
from clickward.session import SkewPolicy
from clickward.sources.audit_log import append_batch, verify_log
from clickward.sources.events import file_manifest, first_rows, read_csv_events, with_column_schema, with_row_ids
from clickward.sources.sinks import write_curated, write_metrics


@dataclass(frozen=True)
class BatchPaths:
    """Folders of a run, all under one root on shared storage."""

    root: str

    @property
    def curated(self) -> str:
        return f"{self.root}/curated"

    @property
    def scored(self) -> str:
        return f"{self.root}/scored"

    @property
    def baselines(self) -> str:
        return f"{self.root}/baselines"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"

    def metrics(self, name: str) -> str:
        return f"{self.root}/metrics/{name}"

    def models(self, name: str) -> str:
        return f"{self.root}/models/{name}"


@dataclass(frozen=True)
class TrustResult:
    scored: DataFrame = field(repr=False)
    curated: DataFrame = field(repr=False)
    report: DataFrame = field(repr=False)
    baseline: DataFrame = field(repr=False)
    seconds: float


def run_trust_stage(
    spark: SparkSession,
    source: str,
    paths: BatchPaths,
    row_cap: int = 0,
    as_of: datetime | None = None,
    policy: SkewPolicy | None = None,
) -> TrustResult:
    """CSV to curated Parquet and quality reports.

    The scored frame is written once; the reports and later stages read it.
    """
    start = time.perf_counter()
    raw = first_rows(with_row_ids(read_csv_events(spark, source)), row_cap, "click_time", "event_id")
    typed = typed_once(raw)
    baseline = stored_baseline(typed, paths.baselines, source, row_cap)
    trust_frames(typed, baseline, as_of, policy=policy).scored.write.mode("overwrite").parquet(paths.scored)
    scored = spark.read.parquet(paths.scored)
    write_curated(scored.where("is_valid_record"), paths.curated, partition_by=("click_day",))
    curated = spark.read.parquet(paths.curated)
    report = validation_report(scored)
    drift = drift_psi_kl(scored, baseline)
    write_metrics(report, paths.metrics("validation_report"))
    write_metrics(drift_long(drift), paths.metrics("drift"))
    write_metrics(group_size_bounds(time_parts(scored)), paths.metrics("outlier_bounds"))
    write_metrics(score_distribution(scored, "is_attributed"), paths.metrics("score_distribution"))
    write_metrics(class_counts(curated, "is_attributed"), paths.metrics("class_counts"))
    return TrustResult(scored, curated, report, baseline, time.perf_counter() - start)


def run_batch(
    spark: SparkSession,
    source: str,
    root: str,
    config: ModelConfig = ModelConfig(),
    tracks: tuple[Track, ...] = (Track.CAUSAL,),
    family: str = "all",
    stability_seeds: tuple[int, ...] = (),
    row_cap: int = 0,
    allow_legacy_target: bool = False,
    as_of: datetime | None = None,
    policy: SkewPolicy | None = None,
) -> dict[str, object]:
    """All stages in order. Returns the stage results; every table is also written."""
    if config.target not in ("is_attributed", "is_fraud"):
        raise ValueError("target must be one of: is_attributed, is_fraud")
    if config.target == "is_fraud" and not allow_legacy_target:
        raise ValueError("The is_fraud target needs allow_legacy_target")
    if config.enable_next_click and Track.CAUSAL in tracks:
        raise ValueError("enable_next_click cannot be used with the production_safe track")
    paths = BatchPaths(root.rstrip("/"))
    trust = run_trust_stage(spark, source, paths, row_cap, as_of, policy)

    results: dict[Track, TrackResult] = {}
    for track in tracks:
        result = results[track] = run_track(trust.curated, config.with_(track=track), family, policy)
        write_metrics(result.board, paths.metrics(f"models/{track.value}"))
        write_metrics(result.sweep, paths.metrics(f"thresholds/{track.value}"))
        write_metrics(result.topk, paths.metrics(f"topk/{track.value}"))
        write_metrics(evaluate.calibration_bins(result.best_test), paths.metrics(f"calibration/{track.value}"))
        write_metrics(evaluate.prob_histogram(result.best_test), paths.metrics(f"histogram/{track.value}"))
        write_metrics(acceptance_checks(result, policy), paths.metrics(f"acceptance/{track.value}"))
        for name, (model, _) in result.fitted.singles.items():
            save_model(spark, model, paths.models(f"{track.value}/{name}"))
        if result.fitted.bagging:
            write_metrics(result.fitted.bagging.manifest, paths.metrics(f"bags/{track.value}"))
            save_model(spark, result.fitted.bagging.model, paths.models(f"{track.value}/BaggedBoosting"))
    write_metrics(evaluate.track_union(*[r.board for r in results.values()]), paths.metrics("models/all"))

    stability = None
    if Track.CAUSAL in tracks and len(set(stability_seeds)) >= 2:
        again = "bagging" if family == "all" else family
        shared = results[Track.CAUSAL].matrix
        runs = [
            (seed, run_track(trust.curated, config.with_(track=Track.CAUSAL, seed=seed), again, policy, shared))
            for seed in sorted(set(stability_seeds))
        ]
        stability = evaluate.seed_stability(stability_runs(spark, runs))
        write_metrics(stability, paths.metrics("stability"))

    metadata = F.to_json(F.struct(F.lit(source).alias("source"), F.lit("batch_curation").alias("stage")))
    append_batch(trust.curated, paths.audit, f"batch_{time.time_ns()}", metadata, time_order(), policy=policy)
    verification = verify_log(spark, paths.audit, policy=policy)
    write_metrics(verification, paths.metrics("audit_verification"))
    manifest = with_column_schema(file_manifest(spark, source), trust.curated)
    write_metrics(manifest, paths.metrics("provenance"))
    return {
        "trust": trust,
        "tracks": results,
        "stability": stability,
        "verification": verification,
        "manifest": manifest,
        "paths": paths,
    }
