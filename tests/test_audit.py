"""Merkle roots, the chained log and what its check notices."""

from __future__ import annotations

import hashlib

import pytest
from paths import SMALL_DIR
from pyspark.sql import functions as F

from clickward.operators import audit as ops
from clickward.operators.ordering import number_order
from clickward.session import SkewPolicy, scratch_path
from clickward.sources import audit_log
from clickward.sources.adapters import clicks_clean

BY_ID = number_order("event_id")


@pytest.fixture(scope="module")
def meta(spark):
    return F.lit('{"stage":"test"}')


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def root_of(hashes: list[str]) -> str:
    level = hashes or [sha("EMPTY")]
    while len(level) > 1:
        level = [sha(a + b) for a, b in zip(level[::2], [*level[1::2], *level[-1:]])]
    return level[0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 1000, 1023, 1024, 1025, 2047, 2049, 3073, 5000])
def test_root(spark, n):
    leaves = spark.range(n).select(
        F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("record_hash")
    )
    got = ops.merkle_root(leaves).first()
    assert tuple(got) == (n, root_of([sha(str(i)) for i in range(n)]))


def test_root_beyond_two_rounds(spark, monkeypatch):
    monkeypatch.setattr(ops, "CHUNK_LEVELS", 3)
    for n in (8, 9, 63, 64, 65, 513, 600):
        leaves = spark.range(n).select(
            F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("record_hash")
        )
        assert ops.merkle_root(leaves).first()["merkle_root"] == root_of([sha(str(i)) for i in range(n)])


def test_positions_of_a_hot_batch(spark):
    clicks = clicks_clean(spark, SMALL_DIR)
    batch = F.when(F.col("event_id") % 3 == 0, "big").otherwise(F.col("ip"))
    tight = SkewPolicy(max_group_rows=20, max_slices=64, broadcast_rows=3)
    plain = ops.merkle_roots(ops.leaves(clicks, batch, BY_ID)).collect()
    assert sorted(plain) == sorted(ops.merkle_roots(ops.leaves(clicks, batch, BY_ID, policy=tight)).collect())


@pytest.fixture(scope="module")
def log(spark, meta):
    """Three appended batches, as small written frames of lines and leaves."""
    path = scratch_path(spark, "audit")
    clicks = clicks_clean(spark, SMALL_DIR)
    for i in range(3):
        audit_log.append_batch(clicks.where(F.col("event_id") % 3 == i), path, f"b{i}", meta, BY_ID)
    return path


def report(spark, lines, leaves, **kwargs):
    return tuple(ops.audit_verify(lines, leaves, **kwargs).first())


def edited(spark, log, **fields):
    """The log with fields of entry 1 replaced."""
    entries = ops.parse_lines(audit_log.read_lines(spark, log))
    for name, value in fields.items():
        entries = entries.withColumn(name, F.when(F.col("seq") == 1, F.lit(value)).otherwise(F.col(name)))
    return ops.to_lines(entries, F.col("ingested_at"))


def test_good_log(spark, log):
    lines, leaves = audit_log.read_lines(spark, log), audit_log.read_leaves(spark, log)
    assert report(spark, lines, leaves) == (True, 3, None, None)
    head = audit_log.last_entry(spark, log)["batch_hash"]
    assert report(spark, lines, leaves, expected_head=head) == (True, 3, None, None)
    assert report(spark, lines.where("seq < 2"), leaves, expected_head=head)[3] == ops.HEAD_MISMATCH
    total = spark.read.parquet(f"{log}/leaves").count()
    assert total == clicks_clean(spark, SMALL_DIR).count()


def test_tampering_is_found(spark, log):
    lines, leaves = audit_log.read_lines(spark, log), audit_log.read_leaves(spark, log)
    assert report(spark, ops.audit_tamper(lines), leaves) == (False, 0, 0, ops.BATCH_MISMATCH)
    assert report(spark, edited(spark, log, batch_metadata="{}"), leaves) == (False, 1, 1, ops.BATCH_MISMATCH)
    assert report(spark, edited(spark, log, batch_id="b9"), leaves)[1:3] == (1, 1)
    assert report(spark, edited(spark, log, merkle_root="0"), leaves) == (False, 1, 1, ops.ROOT_MISMATCH)
    assert report(spark, edited(spark, log, prev_batch_hash="0"), leaves) == (False, 1, 1, ops.PREV_MISMATCH)
    assert report(spark, edited(spark, log, batch_hash="0"), leaves) == (False, 1, 1, ops.BATCH_MISMATCH)
    assert report(spark, edited(spark, log, record_count=5), leaves) == (False, 1, 1, ops.BATCH_MISMATCH)


def test_lost_moved_and_broken_lines(spark, log):
    lines, leaves = audit_log.read_lines(spark, log), audit_log.read_leaves(spark, log)
    assert report(spark, lines.where("seq <> 0"), leaves) == (False, 0, 0, ops.PREV_MISMATCH)
    assert report(spark, lines.where("seq <> 1"), leaves) == (False, 1, 1, ops.PREV_MISMATCH)
    swapped = lines.withColumn("seq", F.expr("case seq when 0 then 1 when 1 then 0 else seq end"))
    assert report(spark, swapped, leaves) == (False, 0, 0, ops.PREV_MISMATCH)
    broken = lines.withColumn("line", F.when(F.col("seq") == 2, F.lit('{"batch_id": ')).otherwise(F.col("line")))
    assert report(spark, broken, leaves) == (False, 2, 2, ops.BROKEN_LINE)
    assert report(spark, lines.where("false"), leaves) == (False, 0, None, ops.MISSING_LOG)


def test_changed_record_is_found(spark, log):
    lines, leaves = audit_log.read_lines(spark, log), audit_log.read_leaves(spark, log)
    one = (F.col("batch_id") == "b2") & (F.col("pos") == 17)
    changed = leaves.withColumn("record_hash", F.when(one, F.lit("0" * 64)).otherwise(F.col("record_hash")))
    assert report(spark, lines, changed) == (False, 2, 2, ops.ROOT_MISMATCH)
    assert report(spark, lines, leaves.where("batch_id <> 'b1'")) == (False, 1, 1, ops.ROOT_MISMATCH)


def test_replayed_batch_adds_nothing(spark, meta):
    path = scratch_path(spark, "audit")
    clicks = clicks_clean(spark, SMALL_DIR)
    numbers = [audit_log.append_batch(clicks, path, name, meta, BY_ID) for name in ("s0", "s1", "s1")]
    assert numbers == [0, 1, 1]
    assert tuple(audit_log.verify_log(spark, path).first()) == (True, 2, None, None)
    assert audit_log.read_leaves(spark, path).select("seq").distinct().count() == 2


def test_equal_batch_ids_are_entries_of_their_own(spark, meta):
    path = scratch_path(spark, "audit")
    clicks = clicks_clean(spark, SMALL_DIR)
    for part in (0, 1, 0):
        audit_log.append_batch(clicks.where(F.col("event_id") % 2 == part), path, "same", meta, BY_ID)
    assert tuple(audit_log.verify_log(spark, path).first()) == (True, 3, None, None)


def test_missing_log(spark):
    assert tuple(audit_log.verify_log(spark, scratch_path(spark, "nothing")).first())[3] == ops.MISSING_LOG


def test_empty_batch(spark, meta):
    path = scratch_path(spark, "audit")
    audit_log.append_batch(clicks_clean(spark, SMALL_DIR).where("false"), path, "none", meta, BY_ID)
    assert tuple(audit_log.verify_log(spark, path).first()) == (True, 1, None, None)
