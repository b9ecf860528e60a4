"""Ordered and grouped work over groups of any size.

A window over `partitionBy(key).orderBy(ts)` puts each key into one task. One
hot key may hold a third of all rows, so groups above the policy's limit are
cut into slices along the order: equal-depth ranges found by one quantile
sketch. The window then runs inside (key, slice), and what earlier slices
contribute comes from a table of one row per hot key and slice. The number of
hot keys and slices is bounded by the policy, whatever the data size.

Where no group exceeds the limit, which one small count job finds out, the
plan is the plain window and families that share a key share one exchange.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickward.session import SkewPolicy


@dataclass(frozen=True)
class Order:
    """A total order: sort columns, and numbers that say where a row lies along it.

    `positions` go from coarse to fine: the first number never falls along the order, each further one
    never falls among rows that agree in all before. All are built when used, so that an order can be
    named before a session exists.
    """

    columns: tuple[str, ...]
    sorting: Callable[[], Sequence[Column]]
    positions: Callable[[DataFrame], Sequence[Column]]

    @property
    def sort(self) -> list[Column]:
        return list(self.sorting())


# A missing value's position, before all others; times and ids of any table lie above it.
LOWEST = -float(2**63)
# Bytes of a text that one exact number holds, and how many such numbers tell texts apart.
TEXT_BYTES = 6
TEXT_POSITIONS = 32


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _position(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(LOWEST))


def _time_positions(df: DataFrame, micros: Column, tie: str) -> list[Column]:
    return [_position(micros), *([_position(F.col(tie))] if _numeric(df, tie) else _text_positions(tie))]


def _text_positions(column: str) -> list[Column]:
    data = F.hex(F.col(column).cast("string").cast("binary"))

    def piece(i: int) -> Column:
        digits = F.substring(data, 2 * TEXT_BYTES * i + 1, 2 * TEXT_BYTES)
        return _position(F.conv(F.rpad(digits, 2 * TEXT_BYTES, "0"), 16, 10))

    return [piece(i) for i in range(TEXT_POSITIONS)]


def time_order(ts: str = "click_time_ts", tie: str = "event_id") -> Order:
    """Order by time, ties by id; rows without a time come first."""

    return Order(
        (ts, tie),
        lambda: (F.col(ts).asc_nulls_first(), F.col(tie).asc()),
        lambda df: _time_positions(df, F.unix_micros(F.col(ts)), tie),
    )


def number_order(*columns: str, descending: bool = False) -> Order:
    """Order by numeric columns; the last ones may be texts."""
    first, *rest = columns

    def sorting() -> list[Column]:
        return [F.col(first).desc() if descending else F.col(first).asc(), *(F.col(c).asc() for c in rest)]

    def positions(df: DataFrame) -> list[Column]:
        out = [F.col(first).cast("double") * F.lit(-1.0) if descending else _position(F.col(first))]
        for c in rest:
            out += [_position(F.col(c))] if _numeric(df, c) else _text_positions(c)
        return out

    return Order(columns, sorting, positions)


def text_order(column: str) -> Order:
    """Order by text."""
    return Order((column,), lambda: (F.col(column).asc(),), lambda df: _text_positions(column))


def text_time_order(ts: str = "click_time", tie: str = "event_id") -> Order:
    """Order by a time given as text; unreadable times come first."""

    def moment() -> Column:
        return F.col(ts).try_cast("timestamp")

    return Order(
        (ts, tie),
        lambda: (moment().asc_nulls_first(), F.col(tie).asc()),
        lambda df: _time_positions(df, F.unix_micros(moment()), tie),
    )


@dataclass(frozen=True)
class Groups:
    """A key family, and how its hot groups are split.

    `count` is the number of groups where it is known, `at_least` a bound below it.
    """

    keys: tuple[str, ...]
    count: int | None = None
    at_least: int = 0
    slices: int = 0
    hot_keys: int = 0
    slice_column: str | None = None
    size_column: str | None = None
    hot: DataFrame | None = field(default=None, repr=False)

    @property
    def parts(self) -> list[str]:
        return [*self.keys, self.slice_column] if self.slice_column else list(self.keys)

    @property
    def split(self) -> bool:
        return self.slice_column is not None


@dataclass(frozen=True)
class GroupStats:
    """How many groups a key family has, over how many rows, and the largest one."""

    groups: int
    rows: int
    largest: int


def group_stats(df: DataFrame, families: Sequence[Sequence[str]]) -> dict[tuple[str, ...], GroupStats]:
    """Statistics of several key families from one job over the key columns.

    Groups are told apart by a 64-bit hash here; where a family turns out to
    have hot groups, `split_groups` counts them again by their keys.
    """
    hashes = [F.struct(F.lit(i).alias("family"), F.xxhash64(*(f or [F.lit(0)])).alias("h")) for i, f in enumerate(families)]
    each = df.select(F.explode(F.array(*hashes)).alias("k")).select("k.family", "k.h")
    sizes = each.groupBy("family", "h").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("family").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.max("n").alias("largest")
    )
    by_number = {r["family"]: GroupStats(r["groups"], r["rows"], r["largest"]) for r in found.collect()}
    return {tuple(f): by_number.get(i, GroupStats(0, 0, 0)) for i, f in enumerate(families)}


def _null_safe_left(df: DataFrame, small: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    renamed = small.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(renamed[f"_r_{k}"])
    right = F.broadcast(renamed) if bounded else renamed
    return df.join(right, condition, "left").drop(*[f"_r_{k}" for k in keys])


def order_slices(df: DataFrame, order: Order, rows: int, policy: SkewPolicy, out: str) -> tuple[DataFrame, int]:
    """Add an equal-depth slice number along the order (0 .. n-1).

    Cuts are quantiles of the first position. A value that fills several slices by itself, like one instant
    of very many rows, becomes a slice of its own, which the next position cuts in the same way.
    """
    wanted = min(policy.max_slices, max(1, math.ceil(rows / policy.max_group_rows)))
    if wanted == 1:
        return df.withColumn(out, F.lit(0)), 1
    found, sliced, slices = {0: wanted}, df.withColumn(out, F.lit(0)), 1
    for position in order.positions(df):
        cut = _cuts(sliced, out, position, found)
        ranges, found, start = [], {}, 0
        for s in range(slices):
            edges, full = cut.get(s, ((), {}))
            ranges.append((s, start, *_stairs(edges)))
            found |= {start + place: count for place, count in full.items()}
            start += len(edges) + 1
        sliced, slices = _placed(sliced, out, position, ranges), start
        if not found:
            break
    return sliced, slices


def _cuts(df: DataFrame, out: str, position: Column, pieces: dict[int, int]) -> dict[int, tuple[list[float], dict[int, int]]]:
    """For slices that have to be cut into so many pieces: the edges between them, and which of the new
    pieces are one value that has to be cut again, into how many.

    There are as many quantiles as slices, so all of this is bounded by the policy.
    """
    most = max(pieces.values())
    shares = [i / most for i in range(1, most)]
    if not shares:
        return {}
    chosen = df.where(F.col(out).isin(list(pieces)))
    sketch = F.percentile_approx(position, shares, max(10_000, 8 * most)).alias("e")
    found = {r[out]: r["e"] for r in chosen.groupBy(out).agg(sketch).collect()}
    result = {}
    for s, quantiles in found.items():
        n = pieces[s]
        taken = [quantiles[min(len(quantiles) - 1, round(i * most / n) - 1)] for i in range(1, n)]
        often = Counter(taken)
        heavy = {v: k + 1 for v, k in often.items() if k > 1}
        edges = sorted({*often, *(math.nextafter(v, math.inf) for v in heavy)})
        result[s] = edges, {bisect.bisect_right(edges, v): k for v, k in heavy.items()}
    return result


def _stairs(edges: Sequence[float]) -> tuple[list[float], list[list[float]]]:
    """Edges in steps, so that a row is compared with the steps and the edges of one of them only."""
    step = max(1, math.isqrt(len(edges)))
    parts = [list(edges[i : i + step]) for i in range(0, len(edges), step)]
    return [p[0] for p in parts], parts


def _placed(df: DataFrame, out: str, position: Column, ranges: list[tuple]) -> DataFrame:
    """Renumber slices: where one starts now, and how many of its edges a row has passed."""
    if len(ranges) == 1:
        edges = [e for part in ranges[0][3] for e in part]
        if not edges:
            return df
        raw = f"{out}_position"
        cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=raw, outputCol=out, handleInvalid="keep")
        return cut.transform(df.drop(out).withColumn(raw, position)).withColumn(out, F.col(out).cast("int")).drop(raw)
    schema = f"{out} int, _start int, _steps array<double>, _edges array<array<double>>"
    table = df.sparkSession.createDataFrame(ranges, schema)
    value = position

    def passed(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda e: e <= value))

    step = passed(F.col("_steps"))
    width = F.size(F.get("_edges", F.lit(0)))
    within = F.when(step == 0, F.lit(0)).otherwise((step - 1) * width + passed(F.get("_edges", step - 1)))
    moved = df.join(F.broadcast(table), out)
    placed = F.when(F.size("_steps") == 0, F.col("_start")).otherwise(F.col("_start") + within)
    return moved.withColumn(out, placed.cast("int")).drop("_start", "_steps", "_edges")


def split_families(
    df: DataFrame,
    families: Sequence[Sequence[str]],
    order: Order,
    policy: SkewPolicy | None = None,
    sizes_of: DataFrame | None = None,
    join_only: Sequence[Sequence[str]] = (),
) -> tuple[DataFrame, dict[tuple[str, ...], Groups]]:
    """Find the hot groups of key families and cut them into slices.

    One job counts the families that contain no other given one. A wider family
    can only be hot inside hot groups of the narrower ones, so it is counted
    only there, if at all. All families share one slicing of the order. An
    empty key list stands for the whole frame as one group.

    `sizes_of` is an earlier, cheaper form of the frame with the same rows, to
    count on. A `join_only` family is not split if its groups are few enough to
    be broadcast.
    """
    policy = policy or SkewPolicy.of(df.sparkSession)
    source = df if sizes_of is None else sizes_of
    ordered = sorted({tuple(f) for f in families}, key=lambda f: (len(f), f))
    few = {tuple(f) for f in join_only}

    def parents(family: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [o for o in ordered if o != family and set(o) < set(family)]

    stats = group_stats(source, [f for f in ordered if not parents(f)])
    rows = max((s.rows for s in stats.values()), default=0)
    limit = policy.group_limit(rows)
    hot: dict[tuple[str, ...], DataFrame] = {}
    groups: dict[tuple[str, ...], Groups] = {}
    for family in ordered:
        above = parents(family)
        known = stats.get(family)
        if known is not None:
            groups[family] = Groups(family, known.groups, known.groups)
            small = family in few and known.groups <= policy.broadcast_rows
            candidates = source if known.largest > limit and not small else None
        else:
            groups[family] = Groups(family, None, max(groups[p].at_least for p in above))
            candidates = source
            for p in above:
                small_parent = p in few and groups[p].count is not None and groups[p].count <= policy.broadcast_rows
                if p not in hot and not small_parent:
                    candidates = None
                    break
                if p in hot:
                    candidates = _semi(candidates, hot[p], p)
        if candidates is None:
            continue
        sizes = candidates.groupBy(*family).agg(F.count(F.lit(1)).alias(_size_name(family)))
        # At most rows / limit <= max_slices groups can be hot, so this is bounded.
        found = sizes.where(F.col(_size_name(family)) > limit).collect()
        if found:
            hot[family] = df.sparkSession.createDataFrame(found, sizes.schema)
            groups[family] = Groups(family, groups[family].count, groups[family].at_least, hot_keys=len(found))
    # Whether a join table is small matters only where its parents' are.
    open_counts = [
        f for f in ordered if f in few and groups[f].count is None and groups[f].at_least <= policy.broadcast_rows
    ]
    if open_counts:
        for family, found_stats in group_stats(source, open_counts).items():
            g = groups[family]
            groups[family] = Groups(family, found_stats.groups, found_stats.groups, hot_keys=g.hot_keys)
    if not hot:
        return df, groups

    out, slices = order_slices(df, order, rows, policy, "_slice_order")
    for family, few_keys in hot.items():
        size, cut = _size_name(family), f"_slice_{'_'.join(family) or 'all'}"
        marked = _null_safe_left(out, few_keys, family, bounded=True) if family else out.withColumn(size, F.lit(rows))
        out = marked.withColumn(cut, F.when(F.col(size).isNotNull(), F.col("_slice_order")).otherwise(F.lit(-1)))
        g = groups[family]
        groups[family] = Groups(family, g.count, g.at_least, slices, g.hot_keys, cut, size, few_keys)
    return out, groups


def _size_name(family: Sequence[str]) -> str:
    return f"_size_{'_'.join(family) or 'all'}"


def _semi(df: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = few.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(right[f"_r_{k}"])
    return df.join(F.broadcast(right), condition, "left_semi")


def split_groups(
    df: DataFrame, keys: Sequence[str], order: Order, policy: SkewPolicy | None = None
) -> tuple[DataFrame, Groups]:
    """`split_families` of a single family."""
    out, groups = split_families(df, [keys], order, policy)
    return out, groups[tuple(keys)]


def _hot_rows(df: DataFrame, groups: Groups) -> DataFrame:
    return df.where(F.col(groups.slice_column) >= 0)


def _carry_fits(groups: Groups, policy: SkewPolicy) -> bool:
    return groups.hot_keys * groups.slices <= policy.broadcast_rows


def prior_sums(
    df: DataFrame,
    groups: Groups,
    order: Order,
    values: Mapping[str, Column],
    policy: SkewPolicy | None = None,
    base: DataFrame | None = None,
    data_type: str = "bigint",
) -> DataFrame:
    """Sum of each value over the earlier rows of the group, 0 on the first row.

    `base` is an earlier form of the frame with the same split and the columns
    of the values. What earlier slices contribute is taken from it, so that a
    chain of features does not repeat itself inside each of its parts.
    """
    before = (
        Window.partitionBy(*groups.parts)
        .orderBy(*order.sort)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast(data_type)
    local = {n: F.coalesce(F.sum(v).over(before).cast(data_type), zero) for n, v in values.items()}
    if not groups.split:
        return df.withColumns(local)
    policy = policy or SkewPolicy.of(df.sparkSession)
    earlier = (
        Window.partitionBy(*groups.keys)
        .orderBy(groups.slice_column)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        _hot_rows(df if base is None else base, groups)
        .groupBy(*groups.parts)
        .agg(*[F.sum(v).cast(data_type).alias(f"_c_{n}") for n, v in values.items()])
        .select(*groups.parts, *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    )
    joined = _null_safe_left(df.withColumns(local), carry, groups.parts, _carry_fits(groups, policy))
    total = {n: (F.col(n) + F.coalesce(F.col(f"_c_{n}"), zero)).cast(data_type) for n in values}
    return joined.withColumns(total).drop(*[f"_c_{n}" for n in values])


def prior_count(
    df: DataFrame,
    groups: Groups,
    order: Order,
    out: str,
    policy: SkewPolicy | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Number of earlier rows of the group."""
    return prior_sums(df, groups, order, {out: F.lit(1)}, policy, base)


def neighbour(
    df: DataFrame,
    groups: Groups,
    order: Order,
    value: str,
    out: str,
    following: bool = False,
    policy: SkewPolicy | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Value of the previous (or following) row of the group, NULL at the end.

    `base` is as in `prior_sums`.
    """
    along = Window.partitionBy(*groups.parts).orderBy(*order.sort)
    shift = F.lead(value) if following else F.lag(value)
    if not groups.split:
        return df.withColumn(out, shift.over(along))
    policy = policy or SkewPolicy.of(df.sparkSession)
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order.columns)], F.col(value).alias("v"))
    edge = F.min(row) if following else F.max(row)
    slices = Window.partitionBy(*groups.keys).orderBy(groups.slice_column)
    carry = (
        _hot_rows(df if base is None else base, groups)
        .groupBy(*groups.parts)
        .agg(edge["v"].alias("_edge"))
        .select(
            *groups.parts,
            (F.lead("_edge") if following else F.lag("_edge")).over(slices).alias("_edge"),
        )
    )
    reverse = Window.partitionBy(*groups.parts).orderBy(
        *[c.desc_nulls_last() if i == 0 else c.desc() for i, c in enumerate(map(F.col, order.columns))]
    )
    at_edge = F.row_number().over(reverse if following else along) == 1
    local = df.withColumns({out: shift.over(along), "_at_edge": at_edge})
    joined = _null_safe_left(local, carry, groups.parts, _carry_fits(groups, policy))
    return joined.withColumn(out, F.when(F.col("_at_edge"), F.col("_edge")).otherwise(F.col(out))).drop(
        "_at_edge", "_edge"
    )


def group_size(df: DataFrame, groups: Groups, out: str) -> DataFrame:
    """Number of rows in the whole group; a hot group's size is known from the split."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*groups.parts))
    if groups.split:
        size = F.coalesce(F.col(groups.size_column), size)
    return df.withColumn(out, size.cast("bigint"))


def attach(df: DataFrame, totals: DataFrame, groups: Groups, policy: SkewPolicy | None = None) -> DataFrame:
    """Left-join a table of one row per group onto the rows, by equality.

    Broadcast if the number of groups was counted and is small. Otherwise the
    join runs on (keys, slice), with the few hot groups' rows of `totals`
    repeated per slice, so that no task gets a whole hot group.
    """
    policy = policy or SkewPolicy.of(df.sparkSession)
    keys = list(groups.keys)
    if groups.count is not None:
        small = groups.count <= policy.broadcast_rows
    else:
        small = groups.at_least <= policy.broadcast_rows and totals.count() <= policy.broadcast_rows
    if small:
        return df.join(F.broadcast(totals), keys, "left")
    if not groups.split:
        return df.join(totals, keys, "left")
    every_slice = F.sequence(F.lit(0), F.lit(groups.slices - 1))
    repeated = _null_safe_left(totals, groups.hot, keys, bounded=True).withColumn(
        groups.slice_column,
        F.explode(F.when(F.col(groups.size_column).isNotNull(), every_slice).otherwise(F.array(F.lit(-1)))),
    )
    return df.join(repeated.drop(groups.size_column), groups.parts, "left")


def drop_helpers(df: DataFrame) -> DataFrame:
    """Remove the columns added by `split_groups`."""
    return df.drop(*[c for c in df.columns if c.startswith(("_slice_", "_size_"))])


def global_index(df: DataFrame, order: Order, out: str = "idx", policy: SkewPolicy | None = None) -> DataFrame:
    """0-based position of each row in the total order of the frame."""
    parted, groups = split_groups(df, [], order, policy)
    return drop_helpers(prior_count(parted, groups, order, out, policy))
