"""Queries of record hashes, Merkle roots and the chained log."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickward.functions.hashing import canonical_record as canonical
from clickward.functions.hashing import record_hash as digest
from clickward.operators import audit as ops
from clickward.operators.ordering import number_order
from clickward.plans.queries import sql
from clickward.plans.queries.registry import query
from clickward.session import materialize
from clickward.sources.adapters import clicks_clean

BY_ID = number_order("event_id")
INGESTED_AT = "2024-02-01T00:00:00+00:00"

# One batch per calendar day, in the order of the ids.
_LEAVES = f"""
leaves AS (
  SELECT substr(click_time, 1, 10) AS batch_id,
    row_number() OVER (PARTITION BY substr(click_time, 1, 10) ORDER BY event_id) - 1 AS pos,
    sha256({sql.CANONICAL}) AS record_hash
  FROM clicks)
"""
_HEADERS = """
headers AS (
  SELECT row_number() OVER (ORDER BY batch_id) - 1 AS seq, batch_id, record_count, merkle_root,
    '{"records":' || record_count || ',"stage":"daily"}' AS batch_metadata
  FROM roots)
"""
CHAIN = f"""
chain AS (
  SELECT seq, batch_id, record_count, merkle_root, batch_metadata, repeat('0', 64) AS prev_batch_hash,
    sha256(repeat('0', 64) || merkle_root || batch_metadata || batch_id || record_count) AS batch_hash
  FROM headers WHERE seq = 0
  UNION ALL
  SELECT h.seq, h.batch_id, h.record_count, h.merkle_root, h.batch_metadata, c.batch_hash,
    sha256(c.batch_hash || h.merkle_root || h.batch_metadata || h.batch_id || h.record_count)
  FROM chain c JOIN headers h ON h.seq = c.seq + 1)
"""
_LOG = (sql.CLEAN, _LEAVES, sql.merkle(), _HEADERS, CHAIN)


def _leaves(spark, sf_dir):
    clicks = clicks_clean(spark, sf_dir)
    return ops.leaves(clicks, F.substring("click_time", 1, 10), BY_ID)


def _chain(leaf_table):
    roots = ops.merkle_roots(leaf_table)
    metadata = F.to_json(F.struct(F.col("record_count").alias("records"), F.lit("daily").alias("stage")))
    first_day = roots.agg(F.min("batch_id").cast("date")).scalar()
    # Days without a record leave gaps; the chain only follows the order.
    headers = ops.batch_headers(roots, metadata, F.date_diff(F.col("batch_id").cast("date"), first_day))
    return ops.audit_chain(headers)


def _lines(leaf_table):
    return ops.to_lines(_chain(leaf_table), F.lit(INGESTED_AT))


def _stored(spark, sf_dir):
    """Log lines and record hashes as a log has them: written."""
    leaf_table = materialize(_leaves(spark, sf_dir), "leaves")
    return materialize(_lines(leaf_table), "lines"), leaf_table


@query(
    "canonical_record",
    sql.with_(sql.CLEAN, select=f"SELECT event_id, {sql.CANONICAL} AS canonical FROM clicks"),
)
def canonical_record(spark, sf_dir):
    return canonical(clicks_clean(spark, sf_dir)).select("event_id", "canonical")


@query(
    "record_hash",
    sql.with_(sql.CLEAN, select=f"SELECT event_id, sha256({sql.CANONICAL}) AS record_hash FROM clicks"),
)
def record_hash(spark, sf_dir):
    clicks = clicks_clean(spark, sf_dir)
    return clicks.select("event_id", digest(clicks).alias("record_hash"))


@query(
    "merkle_root",
    sql.with_(sql.CLEAN, _LEAVES, sql.merkle(), select="SELECT batch_id, record_count, merkle_root FROM roots"),
)
def merkle_root(spark, sf_dir):
    return ops.merkle_roots(_leaves(spark, sf_dir))


@query(
    "audit_chain",
    sql.with_(*_LOG, select="SELECT batch_id, record_count, merkle_root, batch_metadata, prev_batch_hash, batch_hash FROM chain"),
)
def audit_chain(spark, sf_dir):
    return _chain(_leaves(spark, sf_dir)).drop("seq")


_CHUNKS = f"""
leaves AS (
  SELECT idx // 2000 AS batch_id, idx % 2000 AS pos, record_hash FROM (
    SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, sha256({sql.CANONICAL}) AS record_hash FROM clicks))
"""


@query(
    "audit_chunks",
    sql.with_(
        sql.CLEAN, _CHUNKS, sql.merkle(), select="SELECT batch_id, record_count, merkle_root FROM roots"
    ),
)
def audit_chunks(spark, sf_dir):
    return ops.merkle_roots(ops.audit_chunks(clicks_clean(spark, sf_dir), 2000, BY_ID))


@query(
    "audit_verify",
    sql.with_(
        *_LOG,
        """
checked AS (
  SELECT count(*) AS n, bool_and(prev_batch_hash = before AND batch_hash = sha256(prev_batch_hash || merkle_root || batch_metadata || batch_id || record_count)) AS good
  FROM (SELECT *, COALESCE(lag(batch_hash) OVER (ORDER BY seq), repeat('0', 64)) AS before FROM chain))
""",
        select="SELECT good AS success, n AS checked_batches, CAST(NULL AS BIGINT) AS first_mismatch_index, CAST(NULL AS VARCHAR) AS reason FROM checked",
    ),
)
def audit_verify(spark, sf_dir):
    lines, leaf_table = _stored(spark, sf_dir)
    return ops.audit_verify(lines, leaf_table)


@query(
    "audit_tamper",
    sql.with_(
        *_LOG,
        """
tampered AS (
  SELECT seq, CASE WHEN seq = 0 THEN rtrim(batch_metadata, '}') || ',"tampered":true}' ELSE batch_metadata END AS meta, * FROM chain),
bad AS (
  SELECT min(seq) AS first_bad FROM tampered
  WHERE batch_hash <> sha256(prev_batch_hash || merkle_root || meta || batch_id || record_count))
""",
        select="SELECT false AS success, first_bad AS checked_batches, first_bad AS first_mismatch_index, 'batch hash mismatch' AS reason FROM bad",
    ),
)
def audit_tamper(spark, sf_dir):
    """The report on a copy of the log with edited metadata."""
    lines, leaf_table = _stored(spark, sf_dir)
    return ops.audit_verify(ops.audit_tamper(lines), leaf_table)


@query("integrity_overhead")
def integrity_overhead(spark, sf_dir):
    return ops.integrity_overhead(clicks_clean(spark, sf_dir), BY_ID, loops=3, warmup=1)
