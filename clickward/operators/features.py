"""Window and frequency features of clicks.

Ordered features come in a causal form (earlier rows only) and, for
comparison, in a transductive form (the whole frame).
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickward.functions.casting import seconds_between
from clickward.operators.clean import time_parts
from clickward.operators.ordering import (
    Groups,
    Order,
    attach,
    drop_helpers,
    group_size,
    neighbour,
    prior_count,
    prior_sums,
    split_families,
    time_order,
)
from clickward.session import SkewPolicy


class Track(str, Enum):
    """Which rows a feature may look at."""

    CAUSAL = "production_safe"
    TRANSDUCTIVE = "benchmark_transductive"


# Key families of the count features, by output column.
COUNT_FAMILIES = {
    "ip_click_count": ("ip",),
    "app_click_count": ("app",),
    "channel_click_count": ("channel",),
    "ip_app_count": ("ip", "app"),
    "ip_device_os_count": ("ip", "device", "os"),
    "ip_day_hour_count": ("ip", "day", "hour"),
}
# Those of them that have a few large groups.
BY_VALUE = tuple(name for name, keys in COUNT_FAMILIES.items() if keys[0] != "ip")
PAIR = ("app", "channel")
WITH_CHANNEL = ("ip", "app", "channel")
CUMULATIVE_NAMES = {
    "cumcount_ip": "ip_click_count",
    "cumcount_ip_app": "ip_app_count",
    "cumcount_ip_device_os": "ip_device_os_count",
}


def trust_features(df: DataFrame, order: Order | None = None, policy: SkewPolicy | None = None) -> DataFrame:
    """Time parts, click counts, gap to the previous click and frequencies.

    Rows travel once, by ip: the hour counts and the previous click use the
    same exchange. The two joined aggregates are map-side combined and are
    broadcast when their counted size allows it.
    """
    order = order or time_order()
    parts = time_parts(df)
    ip, hour = ("ip",), ("ip", "event_hour")
    base, families = split_families(parts, [ip, hour, PAIR], order, policy, join_only=[PAIR])
    rows = previous_click(base, families[ip], order, policy, base)
    rows = group_size(rows, families[hour], "clicks_per_ip_per_hour")
    rows = attach(rows, ip_totals(parts), families[ip], policy)
    rows = attach(rows, pair_totals(parts), families[PAIR], policy)
    return drop_helpers(rows)


def ip_totals(df: DataFrame) -> DataFrame:
    """Clicks and distinct channels per ip, in one aggregate."""
    per_channel = df.groupBy("ip", "channel").agg(F.count(F.lit(1)).alias("n"))
    return per_channel.groupBy("ip").agg(
        F.sum("n").alias("clicks_per_ip"), F.count("channel").alias("unique_channels_per_ip")
    )


def pair_totals(df: DataFrame) -> DataFrame:
    """Rows per (app, channel)."""
    return df.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("app_channel_freq"))


def previous_click(
    df: DataFrame,
    groups: Groups,
    order: Order,
    policy: SkewPolicy | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Time of the ip's previous click and the whole seconds since it."""
    ts = order.columns[0]
    out = neighbour(df, groups, order, ts, "prev_click_time", policy=policy, base=base)
    gap = (F.unix_seconds(ts) - F.unix_seconds("prev_click_time")).cast("double")
    return out.withColumn("inter_click_seconds", F.when(F.col("prev_click_time").isNull(), 0.0).otherwise(gap))


def app_channel_freq(df: DataFrame, order: Order, policy: SkewPolicy | None = None) -> DataFrame:
    """Add the rows per (app, channel); NULL where either is missing."""
    base, families = split_families(df, [PAIR], order, policy, join_only=[PAIR])
    return drop_helpers(attach(base, pair_totals(df), families[PAIR], policy))


def count_features(
    df: DataFrame,
    track: Track = Track.CAUSAL,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Count, distinct-count and cumulative-count features of a track.

    Expects the columns of `prepare_events`. Counts that the frame has already
    (`placed_rows`) are taken as they are.
    """
    order = order or time_order()
    causal = Track(track) is Track.CAUSAL
    wider = [WITH_CHANNEL] if causal else []
    open_families = [keys for name, keys in COUNT_FAMILIES.items() if name not in df.columns]
    base, families = split_families(df, [*open_families, *wider], order, policy)
    by_ip, by_app = families[("ip",)], families[("ip", "app")]

    def count(frame: DataFrame, name: str) -> DataFrame:
        keys = families[COUNT_FAMILIES[name]]
        return prior_count(frame, keys, order, name, policy, base) if causal else group_size(frame, keys, name)

    # Everything keyed by ip comes first and shares one exchange.
    out = base
    for name in [n for n, keys in COUNT_FAMILIES.items() if keys[0] == "ip"]:
        out = count(out, name)
    if causal:
        by_channel = families[WITH_CHANNEL]
        out = prior_unique(out, by_ip, by_app, order, "ip_unique_app_count", policy, base, "ip_app_count")
        out = prior_unique(out, by_app, by_channel, order, "ip_app_unique_channel_count", policy, base)
        out = out.withColumns({alias: F.col(source) for alias, source in CUMULATIVE_NAMES.items()})
    else:
        for alias, source in CUMULATIVE_NAMES.items():
            out = prior_count(out, families[COUNT_FAMILIES[source]], order, alias, policy, base)
        out = total_uniques(out, df, by_ip, by_app, policy)
    for name in BY_VALUE:
        out = out.select(*[c for c in out.columns if c != name], name) if name in df.columns else count(out, name)
    return drop_helpers(out)


def prior_unique(
    df: DataFrame,
    groups: Groups,
    with_value: Groups,
    order: Order,
    out: str,
    policy: SkewPolicy | None = None,
    base: DataFrame | None = None,
    seen: str | None = None,
) -> DataFrame:
    """Distinct values already seen in the group before this row.

    `with_value` is the family of the group's keys plus the value. A row is the
    first with its value when nothing precedes it there; the answer is the
    number of such rows among the earlier ones. `seen` names a column that has
    the prior count of `with_value` already.
    """
    lean = df if base is None else base
    first = (F.col("_seen") == 0).cast("int")
    if seen:
        flagged = df.withColumn("_seen", F.col(seen))
    else:
        flagged = prior_count(df, with_value, order, "_seen", policy, lean)
    lean_flagged = prior_count(lean, with_value, order, "_seen", policy, lean) if groups.split else None
    return prior_sums(flagged, groups, order, {out: first}, policy, lean_flagged).drop("_seen")


def total_uniques(
    df: DataFrame, source: DataFrame, by_ip: Groups, by_app: Groups, policy: SkewPolicy | None = None
) -> DataFrame:
    """Distinct apps per ip and channels per (ip, app) over all rows of `source`, NULLs not counted."""
    triples = source.groupBy("ip", "app", "channel").agg(F.lit(1).alias("one"))
    channels = triples.groupBy("ip", "app").agg(F.count("channel").alias("ip_app_unique_channel_count"))
    apps = channels.groupBy("ip").agg(F.count("app").alias("ip_unique_app_count"))
    return attach(attach(df, apps, by_ip, policy), channels, by_app, policy)


def delta_features(
    df: DataFrame,
    track: Track = Track.CAUSAL,
    next_click: bool = False,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """Fractional seconds since the previous click of the ip and of (ip, app).

    Seconds to the next click are future knowledge: only on the transductive
    track, and only on request. `sizes_of` is as in `split_families`.
    """
    order = order or time_order()
    ts = order.columns[0]
    base, families = split_families(df, [("ip",), ("ip", "app")], order, policy, sizes_of)
    by_ip, by_app = families[("ip",)], families[("ip", "app")]
    out = base

    def gap(start: str, end: str):
        return F.coalesce(F.greatest(seconds_between(F.col(start), F.col(end)), F.lit(0.0)), F.lit(0.0))

    for groups, name in ((by_ip, "prev_click_delta_sec_ip"), (by_app, "prev_click_delta_sec_ip_app")):
        out = neighbour(out, groups, order, ts, "_other", policy=policy, base=base).withColumn(name, gap("_other", ts))
    if next_click and Track(track) is Track.TRANSDUCTIVE:
        out = neighbour(out, by_ip, order, ts, "_other", following=True, policy=policy, base=base)
        out = out.withColumn("next_click_delta_sec_ip", gap(ts, "_other"))
    return drop_helpers(out.drop("_other"))
