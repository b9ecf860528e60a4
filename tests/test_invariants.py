"""Invariants of splits, bags, encodings, rules and metrics on frames made for them."""

from __future__ import annotations

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from paths import SMALL_DIR
from pyspark.sql import functions as F

from clickward.operators import clean, encoding, evaluate, profile, rules, sampling, splits
from clickward.operators.features import Track, count_features, delta_features
from clickward.operators.ordering import Groups
from clickward.plans.trust import stored_baseline, trust_frames, typed_once
from clickward.sources.events import first_rows
from clickward.session import SkewPolicy, materialize, scratch_path
from clickward.sources import events, sinks
from clickward.sources.adapters import clicks_dirty, model_scores, scored

TIGHT = SkewPolicy(max_group_rows=60, max_slices=64, broadcast_rows=3)
BASE = datetime(2017, 11, 6)


def sample(spark, rows, seed=7, unique_ip=False, step=13):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        ip, app, channel = rng.randrange(10_000, 10_800), rng.randrange(1, 25), rng.randrange(100, 400)
        p = 0.03 + 0.18 * (ip % 17 == 0) + 0.12 * (channel % 13 == 0) + 0.07 * (app % 7 == 0) + rng.gauss(0.02, 0.03)
        y = int(rng.random() < min(0.95, max(0.001, p)))
        ip = 100_000 + i if unique_ip else ip
        data.append((i, BASE + timedelta(seconds=i * step), ip, app, rng.randrange(1, 6), rng.randrange(9, 27), channel, y, 1 - y))
    frame = spark.createDataFrame(
        data,
        "event_id bigint, click_time_ts timestamp, ip bigint, app int, device int, os int, channel int, is_attributed int, is_fraud int",
    )
    return clean.prepare_events(frame)


def test_temporal_split(spark):
    split = splits.temporal_split(sample(spark, 500))
    sizes = {r["split"]: r["split_rows"] for r in splits.split_support(split, "is_attributed").collect()}
    assert sizes == {"train": 300, "val": 100, "test": 100}
    assert tuple(splits.split_overlap(split).first()) == (0, 0, 0)
    assert splits.temporal_order_check(split).first()["temporal_order_valid"]
    with pytest.raises(ValueError):
        splits.temporal_split(sample(spark, 20))


def test_competition_split_days_and_fallback(spark):
    days = splits.competition_split(sample(spark, 300, step=1800))
    last = days.groupBy("split").agg(F.countDistinct(F.to_date("click_time_ts")).alias("d")).collect()
    assert {r["split"]: r["d"] for r in last}["test"] == 1 and {r["split"]: r["d"] for r in last}["val"] == 1
    short = splits.competition_split(sample(spark, 100))
    assert short.select("strategy").distinct().first()[0] == splits.BY_DAY_FALLBACK


def _support(rows, cap, days):
    head = rows[:cap]
    if days is not None and len(set(days[:cap])) >= 3:
        last = sorted(set(days[:cap]))
        val = [y for y, d in zip(head, days) if d == last[-2]]
        test = [y for y, d in zip(head, days) if d == last[-1]]
    else:
        a = max(1, min(int(cap * 0.6), cap - 2))
        b = max(a + 1, min(int(cap * 0.8), cap - 1))
        val, test = head[a:b], head[b:]
    return sum(val), sum(test)


@pytest.mark.parametrize("track", list(Track))
@pytest.mark.parametrize("policy", [None, TIGHT])
def test_window_attempts_against_brute_force(spark, track, policy):
    frame = sample(spark, 700, seed=13, step=700)
    attempts = splits.window_attempts(
        frame, "is_attributed", 100, 90, 7, 7, track=track, policy=policy
    ).collect()
    ordered = frame.orderBy("click_time_ts").select("is_attributed", F.to_date("click_time_ts").alias("d")).collect()
    ys, ds = [r[0] for r in ordered], [r[1] for r in ordered]
    expected, cap = [], 100
    while True:
        val, test = _support(ys, cap, ds if track is Track.TRANSDUCTIVE else None)
        expected.append((cap, val, test))
        if (val >= 7 and test >= 7) or cap >= 700:
            break
        cap = min(700, cap + 90)
    got = sorted((r["cap"], r["val_pos"], r["test_pos"]) for r in attempts if r["window"] == "head")
    assert got == expected
    assert sum(r["selected"] for r in attempts) == 1
    window = splits.select_window(frame, "is_attributed", splits.window_attempts(frame, "is_attributed", 100, 90, 7, 7, track=track))
    assert window.count() == expected[-1][0]


def test_placed_rows_are_ordered_once(spark):
    frame = sample(spark, 400, seed=3)
    placed = splits.placed_rows(frame)
    asked = {"row_cap": 100, "step": 35, "min_val": 3, "min_test": 3}
    attempts = splits.window_attempts(placed, "is_attributed", **asked)
    again = splits.window_attempts(frame, "is_attributed", **asked)
    assert sorted(attempts.collect()) == sorted(again.collect())
    window = splits.select_window(placed, "is_attributed", attempts)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert window.count() == attempts.where("selected").first()["cap"]


def test_window_without_support_names_the_attempts(spark):
    frame = sample(spark, 200)
    attempts = splits.window_attempts(frame, "is_attributed", 100, 50, 10_000, 1)
    assert {r["window"] for r in attempts.collect()} == {"head", "trailing"}
    with pytest.raises(ValueError, match="trailing cap=200"):
        splits.select_window(frame, "is_attributed", attempts)


@pytest.mark.parametrize("policy", [None, TIGHT])
def test_bags_keep_positives_and_ratio(spark, policy):
    frame = spark.range(4040).select(F.col("id").alias("event_id"), (F.col("id") < 40).cast("int").alias("y"))
    a = sampling.bag_subsample(frame, "y", 20, 42, policy=policy)
    b = sampling.bag_subsample(frame, "y", 20, 43, policy=policy)
    assert a.where("y = 1").count() == 40
    assert a.where("y = 0").count() == 800
    assert a.exceptAll(b).count() > 0
    overlap = sampling.bag_overlap([a, b], "y").first()
    assert overlap["shared"] + a.where("y = 0").exceptAll(b.where("y = 0")).count() == 800
    assert sampling.bag_subsample(frame.where("y = 0"), "y", 20).count() == 4000


def test_encoding_blocks_own_label(spark):
    split = splits.temporal_split(sample(spark, 600, seed=31, unique_ip=True))
    encoded, info = encoding.rate_features(split, singles=("ip",), pairs=())
    worst = encoded.where("split = 'train'").agg(F.max(F.abs(F.col("te_ip") - info.global_rate))).first()[0]
    assert worst < 1e-12


@pytest.mark.parametrize("policy", [None, TIGHT])
def test_encoding_of_null_keys(spark, policy):
    frame = sample(spark, 200).withColumn("channel", F.when(F.col("event_id") % 2 == 0, F.col("channel") % 3))
    split = splits.temporal_split(frame)
    encoded, info = encoding.rate_features(split, singles=("channel",), pairs=(), policy=policy)
    missing = encoded.where("channel IS NULL").select("te_channel", "freq_channel_train").distinct().collect()
    assert [tuple(r) for r in missing] == [(info.global_rate, 0.0)]
    assert encoded.where("channel IS NOT NULL and split = 'test' and freq_channel_train = 0").count() == 0


@pytest.mark.parametrize("policy", [None, TIGHT])
def test_encodings_of_all_features_against_each_by_itself(spark, policy):
    """One aggregate for all features, with hot keys and NULL keys, gives what one aggregate each gives."""
    hot = F.when(F.col("event_id") % 3 == 0, 7).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("ip") % 40)
    split = splits.temporal_split(sample(spark, 500).withColumn("ip", hot.cast("bigint")))
    encoded, info = encoding.rate_features(split, policy=policy)
    assert (len(info.singles), len(info.pairs)) == (7, 3)
    folded = encoding.with_folds(split, 300, 5)
    for keys in [*[(k,) for k in info.singles], *encoding.PAIRS]:
        names = ["event_id", f"te_{'_'.join(keys)}", f"freq_{'_'.join(keys)}_train"]
        alone = encoding.encode(folded, [Groups(keys, 0)], "is_attributed", info.global_rate, 5, 20.0)
        want, got = (f.select(names).orderBy("event_id").collect() for f in (alone, encoded))
        assert [r[0] for r in got] == [r[0] for r in want] == list(range(500))
        assert all(abs(a[1] - b[1]) < 1e-12 and a[2] == b[2] for a, b in zip(got, want))


def test_encodings_move_the_frame_for_large_features_only(spark):
    split = materialize(splits.temporal_split(sample(spark, 300)), "split")
    plan = encoding.rate_features(split)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 10 and "Exchange hashpartitioning" not in plan


def test_large_features_share_one_exchange(spark):
    """Features with a common column move the frame once, without histories on it, and keep values and columns."""
    some = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("ip") % 90).cast("bigint")
    split = materialize(splits.temporal_split(sample(spark, 500).withColumn("ip", some)), "split")
    pairs = (("ip", "app"), ("ip", "hour"))
    want, _ = encoding.rate_features(split, singles=("ip", "app"), pairs=pairs)
    got, _ = encoding.rate_features(split, singles=("ip", "app"), pairs=pairs, policy=SkewPolicy(broadcast_rows=60))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 1
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("policy", [None, SkewPolicy(max_group_rows=60), TIGHT])
def test_counts_placed_with_the_rows(spark, policy):
    """Counts by app and channel taken in the slices of the whole order, NULL keys too; the rows then move by ip only."""
    gaps = F.when(F.col("event_id") % 7 > 0, F.col("channel") % 5)
    frame = clean.prepare_events(sample(spark, 500).withColumn("channel", gaps))
    counts = {"app_click_count": ("app",), "channel_click_count": ("channel",)}
    rows = splits.placed_rows(frame, policy=policy, counts=counts)
    want, got = (count_features(f, policy=policy) for f in (frame, rows))
    assert [c for c in got.columns if c != "idx"] == want.columns
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    if policy is not TIGHT:
        assert set(counts) < set(rows.columns)
    if policy is None:
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_next_click_guard(spark):
    frame = sample(spark, 60)
    assert "next_click_delta_sec_ip" not in delta_features(frame, Track.CAUSAL, True).columns
    assert "next_click_delta_sec_ip" in delta_features(frame, Track.TRANSDUCTIVE, True).columns


def test_undecided_rules(spark):
    frames = trust_frames(typed_once(clicks_dirty(spark, SMALL_DIR)), as_of=datetime(2024, 2, 1))
    unknown = frames.flags.where("is_attributed IS NULL")
    assert unknown.count() > 0
    assert unknown.where("rule_schema_valid IS NOT NULL and rule_completeness").count() == 0
    undecided = frames.flags.where("rule_schema_valid IS NULL")
    assert undecided.count() > 0
    ids = undecided.select("event_id")
    assert frames.curated.join(ids, "event_id").count() == 0
    report = {r["rule"]: r for r in rules.validation_report(frames.flags).collect()}
    assert report["rule_schema_valid"]["unknown_count"] == undecided.count()
    assert frames.scored.agg(F.max("veracity_score")).first()[0] <= 1.0 + 1e-12
    summary = rules.validation_summary(frames.flags, frames.baseline).first()
    assert summary["total_records"] == frames.flags.count()
    assert set(summary["drift_metrics"]) == set(profile.PROFILE_COLUMNS)


def test_casts(spark):
    frame = spark.createDataFrame(
        [(1, "111.0", "NaN", "2024-01-01 10:00:00"), (2, "abc", "-3", ""), (3, "99999999999", "1.9", "bad")],
        "event_id bigint, app string, os string, click_time string",
    )
    got = clean.cast_events(frame).orderBy("event_id").select("app", "os", F.col("click_time_ts").isNotNull()).collect()
    assert [tuple(r) for r in got] == [(111, None, True), (None, -3, False), (None, 1, False)]


def test_normalize_refuses_foreign_frames(spark):
    with pytest.raises(ValueError):
        clean.normalize_columns(spark.range(1))


def test_curve_metrics_against_pairs(spark):
    data = scored(spark, SMALL_DIR)
    rows = data.collect()
    pos, neg = [r["p"] for r in rows if r["y"]], [r["p"] for r in rows if not r["y"]]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    for policy in (None, TIGHT):
        got = evaluate.areas(data, policy=policy).first()
        assert math.isclose(got["roc_auc"], wins / len(pos) / len(neg), abs_tol=1e-12)


def test_metrics_of_one_class(spark):
    frame = spark.range(50).select("id", F.lit(0).alias("y"), (F.col("id") / 50).alias("p"))
    got = evaluate.model_metrics(frame).first()
    assert math.isnan(got["roc_auc"]) and got["pr_auc"] == 0.0 and got["mcc"] == 0.0 and got["recall"] == 0.0


@pytest.mark.parametrize("policy", [None, TIGHT])
def test_top_decile_and_quantiles_by_sorting(spark, policy):
    data = scored(spark, SMALL_DIR)
    rows = sorted(data.collect(), key=lambda r: (-r["p"], r["id"]))
    k = max(1, round(0.1 * len(rows)))
    hits = sum(r["y"] for r in rows[:k])
    got = evaluate.top_decile(data, policy=policy).first()
    assert (got["top_decile_k"], got["hits"]) == (k, hits)
    continuous = data.withColumn("p", F.col("p") + F.col("id") / 1e7)
    values = sorted(r["p"] for r in continuous.collect())
    groups = evaluate.score_groups(continuous).withColumn("n", F.col("pos") + F.col("neg"))
    found = {r["share"]: r["value"] for r in evaluate.exact_quantiles(groups, [0.0, 0.1, 0.5, 1.0], policy).collect()}
    for share, value in found.items():
        at = share * (len(values) - 1)
        low = math.floor(at)
        high = math.ceil(at)
        assert math.isclose(value, values[low] + (values[high] - values[low]) * (at - low), abs_tol=1e-12)


def test_leaderboard_puts_missing_metrics_last(spark):
    rows = spark.createDataFrame(
        [("a", float("nan"), 0.1, 0.1), ("b", 0.2, 0.1, 0.1), ("c", None, 0.9, 0.9), ("d", 0.2, 0.3, 0.0)],
        "model string, val_pr_auc double, val_mcc double, val_f1 double",
    )
    assert [r["model"] for r in evaluate.leaderboard(rows).orderBy("place").collect()] == ["d", "b", "c", "a"]


def test_parity_notices_a_wrong_number(spark):
    scores = model_scores(spark, SMALL_DIR)
    logged = evaluate.model_metrics(scores, ("model",))
    assert evaluate.metric_parity(logged, scores).where("parity_pass").count() == 3
    off = logged.withColumn("f1", F.col("f1") + 1e-6)
    assert evaluate.metric_parity(off, scores).where("parity_pass").count() == 0


def test_parity_needs_predictions_and_numbers(spark):
    scores = model_scores(spark, SMALL_DIR)
    logged = evaluate.model_metrics(scores, ("model",))
    absent = logged.unionByName(logged.limit(1).withColumn("model", F.lit("none")))
    assert [r["model"] for r in evaluate.metric_parity(absent, scores).where("not parity_pass").collect()] == ["none"]
    nan = logged.withColumn("pr_auc", F.lit(float("nan")))
    assert evaluate.metric_parity(nan, scores).where("parity_pass").count() == 0


def test_rows_without_a_score_are_left_out(spark):
    scores = model_scores(spark, SMALL_DIR).select("model", "id", "y", "p")
    bad = scores.limit(50).withColumn("p", F.lit(float("nan"))).unionByName(scores.limit(5).withColumn("p", F.lit(None).cast("double")))
    one, other = (evaluate.model_metrics(df, ("model",)).orderBy("model").collect() for df in (scores, scores.unionByName(bad)))
    assert one == other


def test_no_row_drifts_from_its_own_profile(spark):
    typed = clean.cast_events(clicks_dirty(spark, SMALL_DIR))
    marked = rules.mark_known_values(typed, profile.baseline_stats(typed))
    assert marked.where("not rule_drift").count() == 0
    assert marked.columns == [*typed.columns, "rule_drift"]


def test_empty_frame_has_no_drift(spark):
    typed = clean.cast_events(clicks_dirty(spark, SMALL_DIR))
    got = profile.drift_psi_kl(typed.limit(0), profile.baseline_stats(typed)).collect()
    assert len(got) == 4 and {(r["psi"], r["kl"]) for r in got} == {(0.0, 0.0)}


def test_samples_follow_one_rule_at_every_size(spark):
    frame = spark.range(40).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 4).cast("int").alias("y")
    )
    assert sampling.stratified_sample(frame, 1000, "y").where("y is null").count() == 0
    assert sampling.stratified_sample(frame, 10, "y").where("y is null").count() == 0
    for ratio in (1, 100):
        assert sampling.bag_subsample(frame.withColumn("y", F.col("y") - 1), "y", ratio).where("y > 1").count() == 0


def test_stratified_sample_keeps_a_rare_label(spark):
    frame = spark.range(5000).select(F.col("id").alias("event_id"), (F.col("id") == 77).cast("int").alias("is_fraud"))
    got = sampling.stratified_sample(frame, 500)
    assert got.where("is_fraud = 1").count() == 1 and abs(got.count() - 500) <= 2
    assert sampling.stratified_sample(frame, 500, label=None).count() == 500
    assert sampling.stratified_sample(frame, 6000).count() == 5000


def test_baseline_is_kept_for_the_same_source_only(spark):
    store = scratch_path(spark, "store")
    typed = clean.cast_events(clicks_dirty(spark, SMALL_DIR))
    source = f"{SMALL_DIR}/events.parquet"
    first = stored_baseline(typed, store, source).collect()
    other = stored_baseline(typed.limit(10), store, source).collect()
    assert sorted(first) == sorted(other)
    capped = stored_baseline(typed.limit(10), store, source, row_cap=10).collect()
    assert sorted(capped) != sorted(first)


def test_baseline_follows_the_content_of_its_files(spark, tmp_path):
    """Another file of the same name, size and time is another source; the same content again is not."""
    store, path = scratch_path(spark, "store"), tmp_path / "clicks.csv"

    def profile_of(app, typed_app=None):
        path.write_text("click_time,ip,app,device,os,channel\n" + f"2024-01-01 00:00:00,1,{app},1,1,1\n" * 20)
        os.utime(path, (1_700_000_000, 1_700_000_000))
        spark.catalog.refreshByPath(str(path))
        rows = events.read_csv_events(spark, str(path))
        typed = clean.cast_events(rows.withColumn("app", F.lit(typed_app or app)))
        found = stored_baseline(typed, store, str(path), content=rows)
        return {r["value"] for r in found.where("feature = 'app'").collect()}

    assert [profile_of("3"), profile_of("7"), profile_of("3", "9")] == [{"3"}, {"7"}, {"3"}]


def test_csv_binds_by_name(spark):
    path = scratch_path(spark, "csv")
    raw = clicks_dirty(spark, SMALL_DIR)
    raw.select("channel", "ip", "click_time", "app").write.option("header", True).csv(path)
    back = events.read_csv_events(spark, path)
    assert back.columns == list(events.EVENT_COLUMNS)
    assert back.where("device IS NOT NULL").count() == 0
    assert back.select("ip", "app").exceptAll(raw.select("ip", "app")).count() == 0


def test_replayed_stream_batch_replaces_itself(spark):
    path = scratch_path(spark, "batches")
    for _ in range(2):
        sinks.write_stream_batch(spark.range(5), path, 3)
    assert spark.read.parquet(path).count() == 5


def test_samples_end_at_the_same_row_as_an_order_of_all_rows(spark, monkeypatch):
    """Cells of two rows make the search go through every digit; no window runs over all rows."""
    monkeypatch.setattr(sampling, "CELL_ROWS", 2)
    frame = spark.range(700).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("label"))
    ranked = sorted(frame.withColumn("d", sampling.draw(7, "event_id")).collect(), key=lambda r: r["d"])
    quota = spark.createDataFrame([(0, 1), (1, 100), (2, 233)], "label long, quota long")
    got = {(r["label"], r["event_id"]) for r in sampling._filled(frame, quota, "label", sampling.draw(7, "event_id"), "event_id").collect()}
    want = {(r["label"], r["event_id"]) for k, n in ((0, 1), (1, 100), (2, 233)) for r in [x for x in ranked if x["label"] == k][:n]}
    assert got == want
    one_instant = frame.select("event_id", F.lit("2024-01-01 00:00:00").alias("t")).repartition(5)
    kept = first_rows(one_instant, 333, "t", "event_id")
    assert sorted(r["event_id"] for r in kept.collect()) == list(range(333))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert first_rows(one_instant, None, "t", "event_id").count() == 700 == first_rows(one_instant, 900, "t", "event_id").count()
