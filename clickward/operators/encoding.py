"""Smoothed target encodings that never see the row's own label.

A training row is encoded from earlier folds only, a validation or test row
from the whole training part. One aggregate by key has the label sums per fold
side by side; the rows of all features come from a single one by grouping sets.
Features with many groups that share a column are summed by windows instead, in
one exchange by that column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickward.functions.casting import to_whole
from clickward.operators.ordering import Groups, Order, attach, split_families, time_order
from clickward.session import SkewPolicy, materialize

# What is encoded.
SINGLES = ("ip", "app", "device", "os", "channel", "hour", "day")
PAIRS = (("ip", "app"), ("app", "channel"), ("ip", "hour"))


@dataclass(frozen=True)
class EncodingInfo:
    """What an encoding was built from."""

    global_rate: float
    folds: int
    alpha: float
    singles: tuple[str, ...]
    pairs: tuple[str, ...]
    encoding_type: str = "target_mean_oof_temporal"
    fold_strategy: str = "temporal_sequential_folds"


def smoothed(total: Column, count: Column, rate: float, alpha: float) -> Column:
    return (total + F.lit(float(alpha) * float(rate))) / (count + F.lit(float(alpha)))


def smoothed_stats(df: DataFrame, keys: Sequence[str], target: str, rate: float, alpha: float) -> DataFrame:
    """(keys, enc_val, freq_val) over all given rows; rows with a NULL key have no entry."""
    totals = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.sum(target).alias("total"), F.count(target).alias("freq_val")
    )
    return totals.select(*keys, smoothed(F.col("total"), F.col("freq_val"), rate, alpha).alias("enc_val"), "freq_val")


def fold_number(idx: Column, rows: int, folds: int) -> Column:
    """Fold of a training position: the number of fold starts at or before it."""
    folds = max(1, folds)
    starts = [int(j * rows / folds) for j in range(1, folds)]
    out = F.lit(0)
    for start in starts:
        out = out + F.when(idx >= start, 1).otherwise(0)
    return out


def train_summary(df: DataFrame, target: str) -> tuple[int, float]:
    """Rows and mean target of the training part."""
    row = df.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate")).first()
    if not row["n"]:
        raise ValueError("The training part is empty")
    return row["n"], float(row["rate"])


def with_folds(df: DataFrame, rows: int, folds: int) -> DataFrame:
    """Add `_fold`: 0 .. folds-1 for training rows, `folds` for all others."""
    inside = F.col("split") == "train"
    return df.withColumn("_fold", F.when(inside, fold_number(F.col("idx"), rows, folds)).otherwise(max(1, folds)))


def fold_history(df: DataFrame, keys: Sequence[str], target: str, folds: int) -> DataFrame:
    """One row per key: label sums and row counts of the folds before each fold."""
    in_train = df.where(F.col("split") == "train").dropna(subset=list(keys))
    folds = max(1, folds)
    per_fold = in_train.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_fold") < f, F.col(target))).alias(f"s{f}") for f in range(1, folds + 1)],
        *[F.count(F.when(F.col("_fold") < f, F.lit(1))).alias(f"n{f}") for f in range(1, folds + 1)],
    )
    sums = [F.lit(0.0)] + [F.coalesce(F.col(f"s{f}").cast("double"), F.lit(0.0)) for f in range(1, folds + 1)]
    counts = [F.lit(0).cast("bigint")] + [F.col(f"n{f}") for f in range(1, folds + 1)]
    return per_fold.select(*keys, F.array(*sums).alias("_sums"), F.array(*counts).alias("_counts"))


def fold_histories(df: DataFrame, families: Sequence[Sequence[str]], target: str, folds: int) -> DataFrame:
    """(family, keys..., _sums, _counts): `fold_history` of all key families, numbered as given, from one aggregate."""
    folds = max(1, folds)
    columns = list(dict.fromkeys(k for f in families for k in f))
    # The id has a bit for every column that a family leaves out, the first column's the highest.
    left_out = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in f) for f in families]
    number = F.element_at(F.create_map(*[F.lit(v) for i, g in enumerate(left_out) for v in (g, i)]), F.col("_left_out").cast("int"))
    # A row of a family with a NULL key has no entry.
    whole = F.lit(False)
    for i, keys in enumerate(families):
        there = F.col("family") == i
        for k in keys:
            there = there & F.col(k).isNotNull()
        whole = whole | there
    per_fold = (
        df.where(F.col("split") == "train")
        .select(*columns, "_fold", target)
        .groupingSets([list(f) for f in families], *columns)
        .agg(
            F.grouping_id().alias("_left_out"),
            *[F.sum(F.when(F.col("_fold") == f, F.col(target))).alias(f"s{f}") for f in range(folds)],
            *[F.count(F.when(F.col("_fold") == f, F.lit(1))).alias(f"n{f}") for f in range(folds)],
        )
        .withColumn("family", number)
        .where(whole)
    )
    sums, counts = [F.lit(0.0)], [F.lit(0).cast("bigint")]
    for f in range(folds):
        sums.append(sums[-1] + F.coalesce(F.col(f"s{f}").cast("double"), F.lit(0.0)))
        counts.append(counts[-1] + F.col(f"n{f}"))
    return per_fold.select("family", *columns, F.array(*sums).alias("_sums"), F.array(*counts).alias("_counts"))


def _encoded(df: DataFrame, families: Sequence[Sequence[str]], rate: float, alpha: float) -> DataFrame:
    """Replace the joined histories `_sums_<keys>` and `_counts_<keys>` by the encodings."""
    columns, helpers = {}, []
    for name in map("_".join, families):
        sums, counts = f"_sums_{name}", f"_counts_{name}"
        count = F.coalesce(F.get(counts, F.col("_fold")), F.lit(0))
        columns |= _encoding(name, F.get(sums, F.col("_fold")), count, rate, alpha)
        helpers += [sums, counts]
    return df.withColumns(columns).drop(*helpers)


def _encoding(name: str, total: Column, count: Column, rate: float, alpha: float) -> dict[str, Column]:
    value = smoothed(total, count, rate, alpha)
    return {
        f"te_{name}": F.when(count > 0, value).otherwise(F.lit(rate)),
        f"freq_{name}_train": count.cast("double"),
    }


def _windowed(df: DataFrame, keys: Sequence[str], target: str, rate: float, alpha: float) -> DataFrame:
    """Add the encodings of one feature from the rows of the same key in earlier folds, without a join.

    The fold of rows outside the training part is above all others, so no row has them behind it.
    """
    earlier = Window.partitionBy(*keys).orderBy("_fold").rangeBetween(Window.unboundedPreceding, -1)
    summed = df.withColumns({"_total": F.sum(target).over(earlier), "_count": F.count(F.lit(1)).over(earlier)})
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    total = F.col("_total").cast("double")
    count = F.when(whole, F.col("_count")).otherwise(F.lit(0))
    return summed.withColumns(_encoding("_".join(keys), total, count, rate, alpha)).drop("_total", "_count")


def _named(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    name = "_".join(keys)
    return history.select(*keys, F.col("_sums").alias(f"_sums_{name}"), F.col("_counts").alias(f"_counts_{name}"))


def encode(
    df: DataFrame,
    features: Sequence[Groups],
    target: str,
    rate: float,
    folds: int,
    alpha: float,
    policy: SkewPolicy | None = None,
    history_of: DataFrame | None = None,
) -> DataFrame:
    """Add `te_<keys>` and `freq_<keys>_train` for each key family; a key
    without history gets the rate and 0.

    `history_of` is an earlier form of the frame with the same rows, to
    aggregate on.
    """
    source, out = df if history_of is None else history_of, df
    for groups in features:
        out = attach(out, _named(fold_history(source, groups.keys, target, folds), groups.keys), groups, policy)
    return _encoded(out, [g.keys for g in features], rate, alpha)


def rate_features(
    df: DataFrame,
    target: str = "is_attributed",
    folds: int = 5,
    alpha: float = 20.0,
    order: Order | None = None,
    policy: SkewPolicy | None = None,
    singles: Sequence[str] = SINGLES,
    pairs: Sequence[Sequence[str]] = PAIRS,
    history_of: DataFrame | None = None,
) -> tuple[DataFrame, EncodingInfo]:
    """All encodings of a frame with `idx` and `split`; columns that are absent are skipped.

    Positions in the training part must run from 0 in time order, as
    `temporal_split` leaves them. The histories of all features come from one
    aggregate, which is written; features with few groups are then broadcast.
    The others move the frame: once together where they share a column without
    hot groups, else once each. Every feature is encoded before the next one is
    looked at, so no history travels with the frame. `history_of` is an earlier
    form of the frame with the same rows; it is read more than once, so pass
    one that was written to a table.
    """
    order, policy = order or time_order(), policy or SkewPolicy.of(df.sparkSession)

    def cleaned(frame: DataFrame) -> DataFrame:
        return frame.withColumn(target, F.coalesce(to_whole(F.col(target).cast("string"), "int"), F.lit(0)))

    source = cleaned(df if history_of is None else history_of)
    rows, rate = train_summary(source, target)
    folded = with_folds(source, rows, folds)
    out = with_folds(cleaned(df), rows, folds)
    used_singles = [c for c in singles if c in df.columns]
    used_pairs = [tuple(p) for p in pairs if set(p) <= set(df.columns)]
    features = [*[(c,) for c in used_singles], *used_pairs]
    # Sorted by family, so that reading one of them skips the others' row groups.
    made = materialize(fold_histories(folded, features, target, folds).sortWithinPartitions("family"), "histories")
    groups = {r["family"]: r["n"] for r in made.groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [f for i, f in enumerate(features) if groups.get(i, 0) > policy.broadcast_rows]
    families, together = {}, []
    if large:
        # The column that most of them share; its own encoding comes first and makes the exchange of all.
        shared = max(((c,) for c in used_singles), key=lambda c: sum(c[0] in f for f in large), default=())
        out, families = split_families(out, [*large, *([shared] if shared else [])], order, policy, sizes_of=folded)
        if shared and not families[shared].split:
            together = [f for f in large if shared[0] in f and f != shared]
            together = [shared, *together] if together or shared in large else []
    for keys in together:
        out = _windowed(out, keys, target, rate, alpha)
    # Those that move the frame come before those that are broadcast.
    for i, keys in sorted(enumerate(features), key=lambda f: (f[1] not in large, f[0])):
        if keys not in together:
            known = replace(families[keys], count=groups[i]) if keys in large else Groups(keys, groups.get(i, 0))
            out = attach(out, _named(made.where(F.col("family") == i), keys), known, policy)
            out = _encoded(out, [keys], rate, alpha)
    info = EncodingInfo(rate, folds, alpha, tuple(used_singles), tuple("_".join(p) for p in used_pairs))
    # The columns stand as joins on the features' keys, one by one, leave them.
    columns = list(df.columns)
    for keys in features:
        columns = [*keys, *[c for c in columns if c not in keys]]
    names = ["_".join(keys) for keys in features]
    return out.select(*columns, *[c for n in names for c in (f"te_{n}", f"freq_{n}_train")]), info
