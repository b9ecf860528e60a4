"""Histogram trees against a plain search over all rows, on any partitioning."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickward.operators import models, sampling, trees
from clickward.operators.trees import BINS, SCALE, Ensemble, Growth, Growing, Split
from clickward.session import scratch_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    """900 rows; the label depends on a, and on b together with c. Numbers have gaps and few or many values."""

    def drawn(salt, n):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))

    a, b, c = drawn(1, 1000) / 100.0, drawn(2, 7), drawn(3, 2)
    likely = F.when(a > 7, 80).when((b > 3) & (c == 1), 60).otherwise(8)
    return spark.range(900).select(
        F.col("id").alias("event_id"),
        F.when(drawn(4, 50) > 0, a).alias("a"),
        b.alias("b"),
        c.alias("c"),
        F.when(drawn(5, 9) > 0, drawn(6, 500).cast("double")).otherwise(F.lit(float("nan"))).alias("d"),
        (drawn(7, 100) < likely).cast("int").alias("y"),
        (F.col("id") % 4 == 0).alias("val"),
    )


def fitted(df, growth, rounds=6, **more):
    return trees.boosted_trees(df, FEATURES, "y", "event_id", [F.lit(1.0)], [5], growth, rounds, 0.1, **more)


def plain_boosting(df, binning, growth, rounds, rate):
    """Leaf by leaf over all rows in memory, with the same whole-number gradients."""
    rows = df.select("event_id", "y", trees.Binning(tuple(FEATURES), ()).values(df).alias("v")).orderBy("event_id").collect()
    bins = binning.bins(np.array([r["v"] for r in rows]))
    y = np.array([r["y"] for r in rows])
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    score = lambda g, h: (g / SCALE) ** 2 / max(h / SCALE + growth.ridge, 1e-12)

    def best(at, g, h):
        out = (0.0, -1, 0)
        for f in range(bins.shape[1]):
            for cut in range(BINS - 1):
                left = at[bins[at, f] <= cut]
                right = at[bins[at, f] > cut]
                if min(len(left), len(right)) < max(1, growth.min_rows) or min(h[left].sum(), h[right].sum()) < growth.min_hessian * SCALE:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[at].sum(), h[at].sum())
                if gain > out[0] + 1e-9:
                    out = (gain, f, cut)
        return out

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(SCALE * (p - y)), np.rint(SCALE * p * (1 - p))
        leaves = [(np.arange(len(y)), 0)]
        found = [best(leaves[0][0], g, h)]
        while not growth.leaves or len(leaves) < growth.leaves:
            can = [i for i in range(len(leaves)) if found[i][1] >= 0 and (not growth.depth or leaves[i][1] < growth.depth)]
            if not can:
                break
            i = max(can, key=lambda k: (found[k][0], -k))
            (at, depth), (_, f, cut) = leaves.pop(i), found.pop(i)
            for part in (at[bins[at, f] <= cut], at[bins[at, f] > cut]):
                leaves.append((part, depth + 1))
                found.append(best(part, g, h))
        for at, _ in leaves:
            margin[at] += -rate * (g[at].sum() / SCALE) / max(h[at].sum() / SCALE + growth.ridge, 1e-12)
    return {r["event_id"]: float(v) for r, v in zip(rows, 1 / (1 + np.exp(-margin)))}


@pytest.mark.parametrize(
    "growth",
    [Growth(leaves=6, min_rows=20, min_hessian=1e-3), Growth(depth=3, min_hessian=1.0, ridge=1.0), Growth(leaves=12, depth=4, min_rows=5)],
)
def test_same_trees_as_a_plain_search(frame, growth):
    model = fitted(frame, growth)
    want = plain_boosting(frame, model.binning, growth, 6, 0.1)
    got = {r["event_id"]: r["p"] for r in model.transform(frame).select("event_id", "p").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert max(got.values()) > 2 * min(got.values())
    sizes = [int((t.feature < 0).sum()) for t in model.trees[0]]
    assert not growth.leaves or max(sizes) <= growth.leaves
    assert sum(model.importances) == pytest.approx(1.0) and model.importances[0] == max(model.importances)


def test_opening_ahead_changes_no_tree():
    """Any gains: the tree is the one of a search that opens one leaf at a time."""
    rng = np.random.default_rng(1)
    gain = {}

    def split_of(name):
        if name not in gain:
            gain[name] = 0.0 if rng.random() < 0.15 else float(rng.integers(1, 40))
        return gain[name]

    for _ in range(60):
        gain.clear()
        growing, names = Growing(Growth(leaves=9), lambda s: s[0]), {0: ""}
        passes = 0
        while growing.open:
            passes += 1
            found = {}
            for n in growing.open:
                g = split_of(names[n])
                found[n] = Split(g, 0 if g else -1, 0, (1000,), (500,))
            growing.absorb(found)
            for parent, (left, right) in growing.children.items():
                names[left], names[right] = names[parent] + "l", names[parent] + "r"
        inner, leaves = set(), [""]
        while len(leaves) < 9:
            best = max(leaves, key=lambda n: (split_of(n), -len(n)))
            if split_of(best) == 0:
                break
            if sum(split_of(n) == split_of(best) for n in leaves) > 1:
                inner = None  # which of two equal gains is first depends on when nodes were opened
                break
            leaves.remove(best)
            leaves += [best + "l", best + "r"]
            inner.add(best)
        assert passes <= 9
        assert inner is None or {names[n] for n in growing.inner} == inner


def test_same_fit_on_every_partitioning(spark, frame, monkeypatch):
    growth = Growth(leaves=8, min_rows=10, row_share=0.8, column_share=0.7)

    def both(df):
        weights = [F.lit(1.0), (F.col("event_id") % 3 > 0).cast("double")]
        model = trees.boosted_trees(df, FEATURES, "y", "event_id", weights, [5, 6], growth, 9, 0.2, F.col("val"), 4)
        forest = trees.grown_forest(df, FEATURES, "y", "event_id", 7, Growth(depth=5), 3)
        out = model.transform(forest.transform(df, "q"), "p")
        return {r["event_id"]: (r["p"], r["q"]) for r in out.select("event_id", "p", "q").collect()}, model.rounds

    one = both(frame.coalesce(1))
    monkeypatch.setattr(trees, "TASK_ROWS", 150)
    monkeypatch.setattr(trees, "PASS_BYTES", 2000)
    assert both(frame.repartition(5)) == one


def test_early_stop_keeps_the_lowest_loss(frame):
    noise = frame.withColumn("y", F.pmod(F.xxhash64("event_id", F.lit(99)), F.lit(2)).cast("int"))
    model = trees.boosted_trees(noise, FEATURES, "y", "event_id", [F.lit(1.0)], [5], Growth(leaves=16), 60, 0.5, F.col("val"), 5)
    assert len(model.trees[0]) + 5 == model.rounds[0] < 60
    held = noise.where("val").select("y", "a", "b", "c", "d")

    def loss(k):
        part = Ensemble(model.binning, (model.trees[0][:k],), model.margins)
        p = part.transform(held).select("y", "p").collect()
        return -np.mean([np.log(r["p"] if r["y"] else 1 - r["p"]) for r in p])

    assert loss(len(model.trees[0])) <= loss(0) + 1e-9
    nobody = trees.boosted_trees(noise, FEATURES, "y", "event_id", [F.lit(1.0)], [5], Growth(leaves=4), 4, 0.1, F.lit(False), 2)
    assert len(nobody.trees[0]) == 4


def test_forest_balances_the_classes_of_every_bootstrap(spark, frame):
    rare = frame.withColumn("y", ((F.col("y") == 1) & (F.col("event_id") % 5 == 0)).cast("int"))
    forest = trees.grown_forest(rare, FEATURES, "y", "event_id", 30, Growth(depth=1), 3)
    h = np.array([r[0] for r in rare.select(F.xxhash64("event_id")).collect()]).view(np.uint64)
    y = np.array([r[0] for r in rare.select("y").collect()])
    for t, (tree,) in enumerate([(x,) for x in forest.trees[0]][:5]):
        times = trees.bootstrap(h, 3 * 1_000_003 + t)
        n0, n1 = int(times[y == 0].sum()), int(times[y == 1].sum())
        values = forest.binning.bins(np.array([r["v"] for r in rare.select(forest.binning.values(rare).alias("v")).collect()]))
        at = trees.leaves_of(values, tree)
        for node in np.unique(at):
            a = times[(at == node) & (y == 0)].sum() / n0
            b = times[(at == node) & (y == 1)].sum() / n1
            assert tree.value[node] == pytest.approx(b / (a + b))
    # Balanced classes: the mean probability is far above the share of the rare class.
    mean = forest.transform(rare).agg(F.avg("p")).first()[0]
    assert 0.3 < mean < 0.7 and y.mean() < 0.1


def test_odd_frames_and_storage(spark, frame):
    growth = Growth(leaves=4, min_rows=5)
    for df in (frame.where("y = 1"), frame.limit(3), frame.limit(0), frame.withColumn("a", F.lit(None).cast("double"))):
        p = [r["p"] for r in fitted(df, growth, 2).transform(frame).select("p").collect()]
        assert len(p) == 900 and all(0 <= x <= 1 for x in p)
        q = trees.grown_forest(df, FEATURES, "y", "event_id", 3, Growth(depth=2), 1).transform(frame).select("p").collect()
        assert len(q) == 900 and all(0 <= r["p"] <= 1 for r in q)
    text = frame.withColumn("d", F.when(F.col("a") > 7, "x").otherwise("y"))
    model = fitted(text, growth, 3)
    assert model.importances[3] == max(model.importances)
    path = scratch_path(spark, "ensemble")
    model.save(spark, path)
    again = Ensemble.load(spark, path)
    key = lambda m: [r["p"] for r in m.transform(text).orderBy("event_id").select("p").collect()]
    assert key(again) == key(model)


def test_bags_are_plain_filters_and_reported(spark, frame):
    train, val = frame.where("not val"), frame.where("val")
    config = models.ModelConfig(target="y", bag_count=3, neg_pos_ratio=1, rounds=12, num_leaves=5, learning_rate=0.3, patience=3)
    bagging = models.bagged_boosting(train, val, FEATURES, config)
    rows = bagging.manifest.collect()
    pos, neg = models.class_counts(train, "y")
    assert [(r["positive_count"], r["negative_count"]) for r in rows] == [(pos, min(neg, pos))] * 3
    for i, bag in enumerate(bagging.bags):
        same = sampling.bag_subsample(train, "y", 1, config.seed + i)
        assert sorted(r[0] for r in bag.select("event_id").collect()) == sorted(r[0] for r in same.select("event_id").collect())
    assert all(r["trees"] <= r["rounds"] <= 12 for r in rows) and any(r["trees"] for r in rows)


def test_sums_of_a_block_are_those_of_its_rows():
    """Packed or not, with rows left out and slots or channels without any row."""
    rng = np.random.default_rng(3)
    bins = rng.integers(0, BINS, (5, 400)).astype(np.uint8)
    for rows, slots, top in ((400, 3, 9), (250, 4, 9), (0, 2, 9), (250, 3, 1), (250, 3, 2**47)):
        at = np.sort(rng.permutation(400)[:rows])
        slot = rng.integers(0, max(1, slots - 1), rows)
        channels = [rng.integers(-9, 9, rows).astype(float), rng.integers(0, top, rows).astype(float), rng.integers(0, 2, rows) * float(top > 1)]
        for features in (np.tile([0, 3], (slots, 1)), np.sort(rng.integers(0, 5, (slots, 2)), axis=1)):
            want = np.zeros((slots, 2, BINS, 3), np.int64)
            for i, (r, s) in enumerate(zip(at, slot)):
                for j in range(2):
                    want[s, j, bins[features[s, j], r]] += [int(c[i]) for c in channels]
            assert (trees.add_up(slot, at, bins, channels, features) == want).all()


def test_a_task_sends_its_sums_once(spark, monkeypatch):
    """Sums grow with the tasks, so there are no more of them than cores, however many blocks of rows they read."""
    monkeypatch.setattr(trees, "TASK_ROWS", 20)
    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    binning = trees.quantile_binning(df, ["a"], "event_id", 4000)
    table = trees.binned_table(df, binning, "y", "event_id", [F.lit(1.0)], F.lit(False), [0.0], 4000)
    assert table.blocks.getNumPartitions() == table.tasks <= max(spark.sparkContext.defaultParallelism, -(-200 // trees.TASK_BLOCKS))
    assert table.blocks.map(lambda rows: len(rows.h)).sum() == 4000


def both_bags(df, rounds=9, **more):
    weights = [F.lit(1.0), F.when(F.col("event_id") % 3 > 0, 2.5)]
    growth = Growth(leaves=8, min_rows=10, row_share=0.8, column_share=0.7)
    return trees.boosted_trees(df, FEATURES, "y", "event_id", weights, [5, 6], growth, rounds, 0.2, F.col("val"), 4, **more)


def as_lists(model):
    return [[[a.tolist() for a in tree] for tree in grown] for grown in model.trees], model.rounds, model.importances


def test_alone_or_together_the_trees_are_the_same(frame, monkeypatch):
    """Rows of a task in memory or in its file, models in tasks of their own or in the same passes, counted or searched there."""
    odd = frame.withColumn("y", F.when(F.col("event_id") % 11 > 0, F.col("y"))).withColumn("val", F.when(F.col("event_id") % 7 > 0, F.col("val")))
    for df in (odd, odd.where("val"), odd.limit(0)):
        one = as_lists(both_bags(df))
        with monkeypatch.context() as m:
            m.setattr(trees, "TASK_ROWS", 70)
            m.setattr(trees, "ALONE_BLOCK", 30)
            m.setattr(trees, "HELD_BYTES", 5000)
            assert as_lists(both_bags(df.repartition(3))) == one
            m.setattr(trees, "ALONE_ROWS", -1)
            assert as_lists(both_bags(df)) == one
            m.setattr(trees, "MOST_LEAVES", 0)
            assert as_lists(both_bags(df)) == one


def test_a_fit_of_few_rows_needs_no_job_per_round(spark, frame):
    def jobs(rounds):
        group = f"fit-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            both_bags(frame, rounds)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert 0 < jobs(8) == jobs(2)


def test_rows_of_a_task_above_a_limit_are_in_its_file(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [(rng.integers(0, 99, 40).astype(np.uint64), rng.integers(0, 2, 40), rng.random(40) < 0.2, rng.random(40), rng.integers(0, 64, (5, 40)).astype(np.uint8)) for _ in range(9)]
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    for limit in (0, 9000, 1 << 30):
        monkeypatch.setattr(trees, "HELD_BYTES", limit)
        shelf = trees.Shelf(iter(parts), -1.5)
        assert sum(len(b[3]) for b in shelf.blocks if b[3] is not None) <= limit
        assert [b[0] for b in shelf.blocks] == [120, 120, 120]
        for block in shelf:
            block["margin"] += 1.0
        for i, name in enumerate(("h", "y", "held_out", "weight", "bins")):
            assert (np.concatenate([b[name] for b in shelf], -1) == np.concatenate([p[i] for p in parts], -1)).all()
        assert all((b["margin"] == -0.5).all() for b in shelf)


def test_a_written_block_is_a_record_of_its_own(spark, monkeypatch):
    """Spark holds a record several times as it writes one, and puts ten batches into it."""
    monkeypatch.setattr(trees, "TASK_ROWS", 20)
    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    binning = trees.quantile_binning(df, ["a"], "event_id", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        table = trees.binned_table(df, binning, "y", "event_id", [F.lit(1.0)], F.lit(False), [0.0], 4000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert table.blocks.count() > 100
    assert spark.sparkContext._jsc.objectFile(table.path, 1).count() == table.blocks.count()


def test_of_two_siblings_one_is_counted(frame, monkeypatch):
    """The smaller one; the other has the rest of its parent's sums."""
    counted, searched = [], trees.search_sums

    def watched(table, searches, *more):
        counted.append([len(s.features) for s in searches.values()])
        sums = searched(table, searches, *more)
        counted[-1].append([int(s[:, 0, :, 2].sum()) for s in sums[0].values()])
        return sums

    monkeypatch.setattr(trees, "ALONE_ROWS", -1)
    monkeypatch.setattr(trees, "search_sums", watched)
    model = fitted(frame, Growth(depth=4, min_rows=2), 1)
    assert len(model.trees[0][0].feature) > 15
    assert [nodes for nodes, _ in counted] == [1, 1, 2, 4]
    assert counted[0][1] == [900] and all(rows[0] <= 450 for _, rows in counted[1:])
