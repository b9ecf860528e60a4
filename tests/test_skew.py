"""A key and a group of copies that hold a third of the rows each."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from paths import SMALL_DIR
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickward.operators import ordering
from clickward.operators.clean import cast_events, prepare_events
from clickward.operators.features import Track, count_features, delta_features, trust_features
from clickward.operators.rules import mark_first_of_duplicates
from clickward.session import SkewPolicy
from clickward.sources.adapters import clicks_clean

TIGHT = SkewPolicy(max_group_rows=25, max_slices=64, broadcast_rows=10)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one ip, and two thirds of those exact copies at one instant."""
    clicks = cast_events(clicks_clean(spark, SMALL_DIR))
    third, copy = F.col("event_id") % 3 == 0, F.col("event_id") % 9 < 6
    when = F.to_timestamp(F.lit("2024-01-10 12:00:00"))
    same = third & copy
    return clicks.withColumns(
        {
            "ip": F.when(third, F.lit(7)).otherwise(F.col("event_id") % 150).cast("bigint"),
            "click_time_ts": F.when(same, when).otherwise(F.col("click_time_ts")),
            **{c: F.when(same, F.lit(3)).otherwise(F.col(c)).cast("int") for c in ("app", "device", "os", "channel")},
        }
    )


def rows(df, *columns):
    names = columns or tuple(sorted(df.columns))
    return sorted(map(tuple, df.select("event_id", *names).collect()), key=lambda r: r[0])


def test_slices_bound_every_group(spark, hot):
    order = ordering.time_order()
    split, groups = ordering.split_groups(hot, ["ip"], order, TIGHT)
    total = hot.count()
    assert groups.split and groups.hot_keys <= total / TIGHT.max_group_rows
    largest = split.where(F.col(groups.slice_column) >= 0).groupBy(*groups.parts).count().agg(F.max("count")).first()[0]
    assert largest <= 3 * TIGHT.max_group_rows
    cold = split.where(F.col(groups.slice_column) < 0).groupBy("ip").count().agg(F.max("count")).first()[0]
    assert cold <= TIGHT.max_group_rows


def test_slices_follow_the_order(spark, hot):
    order = ordering.time_order()
    split, groups = ordering.split_groups(hot, [], order, TIGHT)
    got = split.select("click_time_ts", "event_id", groups.slice_column).toPandas()
    got = got.sort_values(["click_time_ts", "event_id"])
    assert got[groups.slice_column].is_monotonic_increasing
    assert got[groups.slice_column].nunique() > 10


@pytest.mark.parametrize("track", list(Track))
def test_count_features_do_not_depend_on_the_split(hot, track):
    prepared = prepare_events(hot)
    assert rows(count_features(prepared, track)) == rows(count_features(prepared, track, policy=TIGHT))


def test_other_features_do_not_depend_on_the_split(hot):
    prepared = prepare_events(hot)
    plain = delta_features(prepared, Track.TRANSDUCTIVE, True)
    assert rows(plain) == rows(delta_features(prepared, Track.TRANSDUCTIVE, True, policy=TIGHT))
    assert rows(trust_features(hot)) == rows(trust_features(hot, policy=TIGHT))


def test_counts_against_pandas(hot):
    got = count_features(prepare_events(hot), Track.CAUSAL, policy=TIGHT).toPandas()
    got = got.sort_values(["click_time_ts", "event_id"]).reset_index(drop=True)
    assert (got["ip_click_count"] == got.groupby("ip").cumcount()).all()
    assert (got["ip_app_count"] == got.groupby(["ip", "app"]).cumcount()).all()
    seen, expected = {}, []
    for ip, app in zip(got["ip"], got["app"]):
        expected.append(len(seen.setdefault(ip, set())))
        seen[ip].add(app)
    assert got["ip_unique_app_count"].tolist() == expected


def test_copies_leave_one(hot):
    for policy in (None, TIGHT):
        flagged = mark_first_of_duplicates(hot, policy=policy)
        key = ["ip", "app", "device", "os", "channel", "click_time_ts"]
        assert flagged.where("rule_uniqueness").count() == hot.select(*key).distinct().count()
        first = flagged.where(F.col("rule_uniqueness")).groupBy(*key).agg(F.min("event_id").alias("kept"))
        lowest = hot.groupBy(*key).agg(F.min("event_id").alias("kept"))
        assert first.exceptAll(lowest).count() == 0


def test_attach_joins_hot_keys_by_slice(spark, hot):
    order = ordering.time_order()
    split, groups = ordering.split_groups(hot, ["ip"], order, TIGHT)
    totals = hot.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    joined = ordering.attach(split, totals, groups, TIGHT)
    assert joined.count() == hot.count()
    expected = hot.groupBy("ip").count().toPandas().set_index("ip")["count"]
    got = joined.select("ip", "n").distinct().toPandas().set_index("ip")["n"]
    assert got.sort_index().equals(expected.sort_index().rename("n"))


def test_values_of_one_instant_are_sliced_by_id(spark):
    frame = spark.range(1000).select(
        F.col("id").alias("event_id"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("click_time_ts")
    )
    indexed = ordering.global_index(frame, ordering.time_order(), policy=TIGHT)
    assert indexed.where("idx <> event_id").count() == 0
    split, groups = ordering.split_groups(frame, [], ordering.time_order(), TIGHT)
    assert split.groupBy(groups.slice_column).count().agg(F.max("count")).first()[0] < 100


def test_null_is_a_key_like_any_other(spark):
    frame = spark.createDataFrame(
        [(i, None if i % 3 else 1, datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(200)],
        "event_id bigint, ip bigint, click_time_ts timestamp",
    )
    order = ordering.time_order()
    split, groups = ordering.split_groups(frame, ["ip"], order, TIGHT)
    counted = ordering.prior_count(split, groups, order, "n", TIGHT).toPandas().sort_values("event_id")
    assert counted["n"].tolist() == counted.groupby("ip", dropna=False).cumcount().tolist()


def test_slices_of_one_instant_and_of_texts_with_a_common_start(spark):
    """5,000 rows of one instant among far dates, and 5,000 addresses with one start, under a limit of 100."""
    policy = SkewPolicy(max_group_rows=100)
    instant = F.when(F.col("id") < 5000, F.lit(1_700_000_000)).otherwise((F.col("id") - 5000) * 3_000_000)
    frame = spark.range(5600).select(
        F.when(F.col("id") != 5100, F.timestamp_seconds(instant)).alias("click_time_ts"),
        (F.col("id") * 7919 % 5600).alias("event_id"),
        F.concat(F.lit("https://www.example.com/a/long/path/"), F.lpad(F.hex("id"), 6, "0")).alias("url"),
    )
    for order in (ordering.time_order(), ordering.text_order("url"), ordering.number_order("event_id", descending=True)):
        sliced, slices = ordering.order_slices(frame.repartition(7), order, 5600, policy, "s")
        rows = sliced.groupBy("s").count().collect()
        assert max(r["count"] for r in rows) < 300 and len(rows) <= slices <= 4 * 56
        placed = sliced.withColumn("place", F.row_number().over(Window.orderBy(*order.sort))).select("place", "s").orderBy("place").collect()
        assert [r["s"] for r in placed] == sorted(r["s"] for r in placed)
    index = ordering.global_index(frame, ordering.time_order(), policy=policy)
    want = frame.withColumn("n", F.row_number().over(Window.orderBy(*ordering.time_order().sort)) - 1)
    assert index.join(want, "event_id").where("idx != n").count() == 0


def test_few_values_and_nested_ties_are_sliced_in_order(spark):
    policy = SkewPolicy(max_group_rows=50)
    frame = spark.range(4000).select(
        F.expr("id % 3").alias("a"), F.when(F.col("id") % 5 > 0, F.expr("id % 7")).alias("b"), F.col("id").alias("c")
    )
    order = ordering.number_order("a", "b", "c")
    sliced, _ = ordering.order_slices(frame.repartition(5), order, 4000, policy, "s")
    assert max(r["count"] for r in sliced.groupBy("s").count().collect()) < 150
    placed = sliced.select("s", "a", "b", "c").collect()
    key = lambda r: (r["a"], r["b"] is not None, r["b"] or 0, r["c"])
    assert [r["s"] for r in sorted(placed, key=key)] == sorted(r["s"] for r in placed)
