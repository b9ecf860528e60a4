"""Typing, cleaning and column selection of click events."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickward.functions.casting import to_time, to_whole
from clickward.operators.ordering import Groups, attach, global_index, number_order, split_families, text_order
from clickward.sources.events import EVENT_COLUMNS

# Names a model must not see.
FORBIDDEN_FEATURES = (
    "is_fraud",
    "is_attributed",
    "attributed_time",
    "attributed_time_ts",
    "record_hash",
    "batch_hash",
    "audit_pass",
    "click_time",
)
FORBIDDEN_PART = "attributed_time"

# Other names for the click time, first match wins.
TIME_ALIASES = ("timestamp", "event_time", "ts")
KEY_COLUMNS = ("click_time", "ip", "app", "device", "os", "channel")


def cast_events(df: DataFrame) -> DataFrame:
    """Typed click events; a missing column counts as all NULL, bad text as NULL."""
    missing = {c: F.lit(None).cast("string") for c in EVENT_COLUMNS if c not in df.columns}
    typed = {
        "click_time_ts": to_time("click_time"),
        "attributed_time_ts": to_time("attributed_time"),
        "ip": to_whole("ip", "bigint"),
        **{c: to_whole(c, "int") for c in ("app", "device", "os", "channel", "is_fraud", "is_attributed")},
    }
    return derive_is_fraud(df.withColumns(missing).withColumns(typed))


def derive_is_fraud(df: DataFrame) -> DataFrame:
    """Where the fraud label is missing, it is the complement of the attribution."""
    return df.withColumn("is_fraud", F.coalesce("is_fraud", F.lit(1) - F.col("is_attributed")))


def time_parts(df: DataFrame, ts: str = "click_time_ts") -> DataFrame:
    return df.withColumns(
        {
            "click_hour": F.hour(ts),
            "click_day": F.dayofmonth(ts),
            "click_weekday": F.dayofweek(ts),
            "click_minute": F.minute(ts),
            "event_hour": F.date_trunc("hour", ts),
        }
    )


def prepare_events(df: DataFrame, ts: str = "click_time_ts") -> DataFrame:
    """Rows with a usable time, with the parts the model features need.

    The rows stay unsorted: every later operator names its own order.
    """
    return df.where(F.col(ts).isNotNull()).withColumns(
        {"day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts)}
    )


def click_unix(df: DataFrame, ts: str = "click_time_ts") -> DataFrame:
    return df.withColumn("click_unix", F.coalesce(F.unix_seconds(ts), F.lit(0)).cast("bigint"))


def clean_target(df: DataFrame, target: str) -> DataFrame:
    """Target as 0/1 integer; anything unreadable counts as 0."""
    return df.withColumn(target, F.coalesce(to_whole(F.col(target).cast("string"), "int"), F.lit(0)))


def require_two_classes(df: DataFrame, target: str) -> None:
    seen = df.agg(F.min(target).alias("low"), F.max(target).alias("high")).first()
    if seen["low"] == seen["high"]:
        raise ValueError("All rows have one and the same target")


def safe_features(columns: Iterable[str], target: str) -> list[str]:
    """Columns that cannot tell the target: not excluded by name, not the target, without the telling part."""
    telling = re.compile(f"{re.escape(target)}|.*{re.escape(FORBIDDEN_PART)}.*", re.IGNORECASE | re.DOTALL)
    kept = [c for c in columns if c not in FORBIDDEN_FEATURES and not telling.fullmatch(c)]
    if not kept:
        raise ValueError("Every column gives the target away, so there is nothing to learn from")
    return kept


def safe_feature_select(df: DataFrame, target: str = "is_attributed", keep: Iterable[str] = ()) -> DataFrame:
    """Only columns a model may see, plus named key columns."""
    kept = list(keep)
    return df.select(*kept, *[c for c in safe_features(df.columns, target) if c not in kept])


def curate(df: DataFrame) -> DataFrame:
    """Rows that pass every rule; an undecided rule does not pass."""
    return df.where(F.col("is_valid_record"))


def _sources(columns: Sequence[str]) -> dict[str, list[Column]]:
    """For each expected column the expressions that can fill it, best first."""
    have = set(columns)
    spelled = {c.lower(): c for c in reversed(columns)}
    fills: dict[str, list[Column]] = {c: [F.col(c)] if c in have else [] for c in EVENT_COLUMNS}
    fills["click_time"] += [F.col(spelled[a]) for a in TIME_ALIASES if a in spelled]
    fills["is_fraud"] += [(F.lit(1) - to_whole("is_attributed", "int")).cast("string")] if "is_attributed" in have else []
    fills["is_fraud"] += [F.col("label")] if "label" in have else []
    fills["attributed_time"] += [F.lit("")]
    return fills


def normalize_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Bring a foreign click file to the nine expected columns, plus named ones, in one projection."""
    shared = len(set(KEY_COLUMNS) & set(df.columns))
    if shared < 4:
        raise ValueError(f"No click file: it has {shared} of the {len(KEY_COLUMNS)} key columns, and 4 are needed")
    missing = F.lit(None).cast("string")
    filled = [next(iter(fills), missing).alias(name) for name, fills in _sources(df.columns).items()]
    return df.select(*keep, *filled)


def tree_frame(df: DataFrame, categorical: Iterable[str] = (), keys: Iterable[str] = ()) -> DataFrame:
    """All-numeric frame for tree learners: times as epoch seconds, booleans as
    0/1, text as the rank of its value in sorted order, gaps and infinities -1.

    The code table of a text column has one row per distinct value.
    """
    kept, texts = list(keys), set(categorical)
    out = df
    for field in df.schema.fields:
        if field.name not in kept and isinstance(field.dataType, T.StringType):
            texts.add(field.name)
    for name in sorted(texts):
        out = _with_codes(out, df, name, kept[0] if kept else None)

    def number(field: T.StructField) -> Column:
        c = F.col(field.name)
        if field.name in kept:
            return c
        if field.name in texts:
            value = F.coalesce(F.col(f"_code_{field.name}"), F.lit(-1)).cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            value = F.unix_seconds(c.cast("timestamp")).cast("double")
        else:
            value = c.cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        return F.when(finite, value).otherwise(F.lit(-1.0)).alias(field.name)

    return out.select(*[number(f) for f in df.schema.fields])


def _with_codes(df: DataFrame, source: DataFrame, name: str, row_id: str | None) -> DataFrame:
    """Add the rank of each text. Where there are very many texts, a row id spreads a frequent one."""
    values = source.where(F.col(name).isNotNull()).select(name).distinct()
    codes = global_index(values, text_order(name), out=f"_code_{name}")
    if row_id is None:
        return attach(df, codes, Groups((name,)))
    rows, families = split_families(df, [(name,)], number_order(row_id), sizes_of=source, join_only=[(name,)])
    return attach(rows, codes, families[(name,)])
