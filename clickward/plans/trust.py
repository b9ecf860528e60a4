"""The trust stage: typed events to flags, scores and curated rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.operators.clean import cast_events, curate, time_parts
from clickward.operators.features import trust_features
from clickward.operators.profile import baseline_stats
from clickward.operators.rules import group_size_bounds, veracity_checks, veracity_score
from clickward.session import SkewPolicy, materialize
from clickward.sources.events import file_manifest


@dataclass(frozen=True)
class TrustFrames:
    """The lazy frames of one run."""

    typed: DataFrame
    features: DataFrame
    baseline: DataFrame
    flags: DataFrame
    scored: DataFrame
    curated: DataFrame


def typed_once(raw: DataFrame) -> DataFrame:
    """Typed events as a written table.

    The trust stage passes over its input several times, for totals, profile,
    fences and rows. Each pass then reads only its own columns of a columnar
    table, instead of parsing all text again.
    """
    return materialize(cast_events(raw), "typed")


def trust_frames(
    typed: DataFrame,
    baseline: DataFrame | None = None,
    as_of: datetime | None = None,
    weights: dict[str, float] | None = None,
    policy: SkewPolicy | None = None,
) -> TrustFrames:
    """All frames from typed events with a row id `event_id`.

    Without a stored baseline the frame's own profile is the baseline.
    """
    features = trust_features(typed, policy=policy)
    known = baseline if baseline is not None else baseline_stats(typed)
    flags = veracity_checks(
        features,
        known,
        as_of,
        bounds=group_size_bounds(time_parts(typed)),
        policy=policy,
        sizes_of=typed,
    )
    scored = veracity_score(flags, weights)
    return TrustFrames(typed, features, known, flags, scored, curate(scored))


def stored_baseline(
    typed: DataFrame, store: str, source: str, row_cap: int = 0, content: DataFrame | None = None
) -> DataFrame:
    """The stored profile of the same source files and row cap, or a new one.

    Profiles live in one folder per key, made from names, sizes and digests of the files' bytes, so a file that was
    replaced by another of the same size and time has a profile of its own, and a restored one finds its old profile.
    `content` is as in `file_manifest`.
    """
    listed = file_manifest(typed.sparkSession, source, content=content)
    named = F.concat_ws("|", "file", "bytes", "sha256")
    # Sums of hash parts commute, so no list of files is gathered anywhere.
    parts = [F.sum(F.conv(F.substring(F.sha2(named, 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    files = F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts)
    key = listed.agg(F.sha2(F.concat_ws("|", files, F.lit(source), F.lit(str(row_cap))), 256).alias("k")).first()["k"]
    return first_baseline(typed, f"{store}/{key}")


def first_baseline(typed: DataFrame, path: str) -> DataFrame:
    """The profile stored at a path; the first caller stores that of its own rows.

    A profile is a few rows in one file, so it appears there whole or not at all.
    """
    spark = typed.sparkSession
    known = _table_if_written(spark, path)
    if known is None:
        profile = baseline_stats(typed).withColumn("generated_at", F.current_timestamp())
        profile.coalesce(1).write.mode("overwrite").parquet(path)
        known = spark.read.parquet(path)
    return known.select("feature", "value", "share")


def _table_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
