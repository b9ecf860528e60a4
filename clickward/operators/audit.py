"""Tamper evidence: record hashes, Merkle roots, a hash-chained log and its check.

A log has one entry per batch. The record hashes of a batch, which may be
billions, are a table of their own: (batch_id, pos, record_hash).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickward.functions.hashing import EMPTY_TEXT, GENESIS, canonical_json, record_hash
from clickward.operators.ordering import (
    Order,
    drop_helpers,
    global_index,
    neighbour,
    number_order,
    prior_count,
    split_groups,
    time_order,
)
from clickward.session import SkewPolicy, materialize

# 2^10 leaves make one task-sized group; there are as many rounds as the largest batch needs.
CHUNK_LEVELS = 10

# Why a log fails.
MISSING_LOG = "audit log missing"
BROKEN_LINE = "invalid json line"
PREV_MISMATCH = "prev hash mismatch"
ROOT_MISMATCH = "merkle root mismatch"
BATCH_MISMATCH = "batch hash mismatch"
COUNT_MISMATCH = "record count mismatch"
HEAD_MISMATCH = "head hash mismatch"

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("batch_hash", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("batch_metadata", T.StringType()),
        T.StructField("ingested_at", T.StringType()),
        T.StructField("merkle_root", T.StringType()),
        T.StructField("prev_batch_hash", T.StringType()),
        T.StructField("record_count", T.LongType()),
    ]
)


def leaves(
    df: DataFrame,
    batch: Column,
    order: Order | None = None,
    columns: Sequence[str] | None = None,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """(batch_id, pos, record_hash) of every record, in the given order per batch."""
    order = order or time_order()
    named = df.withColumns({"batch_id": batch.cast("string"), "record_hash": record_hash(df, columns)})
    parted, groups = split_groups(named, ["batch_id"], order, policy)
    return prior_count(parted, groups, order, "pos", policy).select("batch_id", "pos", "record_hash")


def _reduce_chunk(hashes: Column, lift: Column) -> Column:
    """Hash pairs level by level; an odd last node pairs with itself.

    A first chunk stops at its root. A later chunk, which cannot be the only
    one, is lifted through all levels of the chunk.
    """

    def pair(level: Column) -> Column:
        left = F.transform(
            F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int")),
            lambda i: F.sha2(
                F.concat(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))), 256
            ),
        )
        return F.when((F.size(level) > 1) | lift, left).otherwise(level)

    levels = F.sequence(F.lit(1), F.lit(CHUNK_LEVELS))
    start = F.filter(hashes, lambda h: F.lit(True))
    return F.get(F.reduce(levels, start, lambda level, _: pair(level)), F.lit(0))


def merkle_roots(leaf_table: DataFrame, key: str = "batch_id") -> DataFrame:
    """(key, record_count, merkle_root). Each group holds at most one chunk of a batch.

    Chunks are aligned, so reducing each one alone and then the chunk roots
    gives the same root as working level by level over the whole batch. Each
    round is written, a thousandth of the one before, until every batch is down
    to one node.
    """
    width = 1 << CHUNK_LEVELS
    nodes = leaf_table.select(key, "pos", F.col("record_hash").alias("node"), F.lit(1).cast("bigint").alias("n"))
    while True:
        nodes = (
            nodes.groupBy(key, F.floor(F.col("pos") / width).alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("level"), F.sum("n").alias("n"))
            .select(
                key,
                F.col("chunk").alias("pos"),
                _reduce_chunk(F.col("level.node"), F.col("chunk") > 0).alias("node"),
                "n",
            )
        )
        nodes = materialize(nodes, "merkle")
        if nodes.where(F.col("pos") > 0).isEmpty():
            break
    return nodes.select(key, F.col("n").alias("record_count"), F.col("node").alias("merkle_root"))


def merkle_root(leaf_table: DataFrame) -> DataFrame:
    """The root of a single batch as one row; that of the empty text for no records."""
    one = merkle_roots(leaf_table.withColumn("_one", F.lit(0)), "_one")
    return one.agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
        F.coalesce(F.max("merkle_root"), F.sha2(F.lit(EMPTY_TEXT).cast("binary"), 256)).alias("merkle_root"),
    )


def entry_hash(prev: Column) -> Column:
    return F.sha2(
        F.concat(prev, F.col("merkle_root"), F.col("batch_metadata"), F.col("batch_id"), F.col("record_count").cast("string")),
        256,
    )


def audit_chain(headers: DataFrame, start: str = GENESIS) -> DataFrame:
    """Link batch headers (seq, batch_id, record_count, merkle_root, batch_metadata) in `seq` order.

    Each hash needs the one before, so the links are made one after another by
    a single task. It sees one short row per batch, never a record, and holds
    only the last hash.
    """
    names = ["seq", "batch_id", "record_count", "merkle_root", "batch_metadata"]
    schema = "seq bigint, batch_id string, record_count bigint, merkle_root string, batch_metadata string, prev_batch_hash string, batch_hash string"

    def link(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = start
        for part in parts:
            before, after = [], []
            for root, meta, batch, count in zip(
                part["merkle_root"], part["batch_metadata"], part["batch_id"], part["record_count"]
            ):
                before.append(last)
                last = hashlib.sha256(f"{last}{root}{meta}{batch}{count}".encode()).hexdigest()
                after.append(last)
            yield part.assign(prev_batch_hash=before, batch_hash=after)

    ordered = headers.select(
        F.col("seq").cast("bigint").alias("seq"), *[F.col(n) for n in names[1:]]
    ).repartition(1).sortWithinPartitions("seq")
    return ordered.mapInPandas(link, schema)


def batch_headers(roots: DataFrame, metadata: Column, seq: Column) -> DataFrame:
    return roots.select(
        seq.cast("bigint").alias("seq"), "batch_id", "record_count", "merkle_root", metadata.alias("batch_metadata")
    )


def audit_chunks(
    df: DataFrame, size: int = 2000, order: Order | None = None, policy: SkewPolicy | None = None
) -> DataFrame:
    """Leaves of consecutive batches of `size` records in the order of the frame."""
    indexed = global_index(df, order or time_order(), "idx", policy)
    return indexed.select(
        F.floor(F.col("idx") / size).cast("bigint").alias("batch_id"),
        (F.col("idx") % size).alias("pos"),
        record_hash(df).alias("record_hash"),
    )


def to_lines(entries: DataFrame, ingested_at: Column) -> DataFrame:
    """(seq, line): each entry as one JSON text with sorted names."""
    fields = [
        F.col("batch_hash"),
        F.col("batch_id"),
        F.col("batch_metadata"),
        ingested_at.cast("string").alias("ingested_at"),
        F.col("merkle_root"),
        F.col("prev_batch_hash"),
        F.col("record_count"),
    ]
    return entries.select("seq", F.to_json(F.struct(*fields)).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Entries of a log; a line that is no JSON object is marked `broken`."""
    schema = T.StructType([*ENTRY_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("line", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    return (
        lines.where(F.trim("line") != "")
        .select("seq", parsed.alias("e"))
        .select("seq", "e.*", (F.col("e").isNull() | F.col("e._corrupt").isNotNull()).alias("broken"))
        .drop("_corrupt")
    )


def audit_verify(
    lines: DataFrame,
    leaf_table: DataFrame,
    expected_head: str | None = None,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """One row: success, checked_batches, first_mismatch_index and reason.

    Every entry is checked on its own against its predecessor, in parallel; the
    first bad one counts. Beyond the links, the roots are rebuilt from the
    record hashes and the counts compared. Entries cut from the end only show
    against an expected head hash.
    """
    order = number_order("seq")
    entries = parse_lines(lines)
    parted, whole = split_groups(entries, [], order, policy)
    placed = prior_count(parted, whole, order, "index", policy, parted)
    linked = drop_helpers(neighbour(placed, whole, order, "batch_hash", "_before", policy=policy, base=parted))
    # A stored log numbers its entries; two of them may carry one batch id.
    key = "seq" if "seq" in leaf_table.columns else "batch_id"
    rebuilt = merkle_roots(leaf_table, key).withColumnsRenamed({"record_count": "_count", "merkle_root": "_root"})
    joined = linked.join(rebuilt, key, "left")
    root = F.coalesce("_root", F.sha2(F.lit(EMPTY_TEXT).cast("binary"), 256))

    def differs(a: Column, b: Column) -> Column:
        return ~a.eqNullSafe(b)

    reason = (
        F.when(F.col("broken"), BROKEN_LINE)
        .when(differs(F.col("prev_batch_hash"), F.coalesce("_before", F.lit(GENESIS))), PREV_MISMATCH)
        .when(differs(root, F.col("merkle_root")), ROOT_MISMATCH)
        .when(differs(entry_hash(F.col("prev_batch_hash")), F.col("batch_hash")), BATCH_MISMATCH)
        .when(differs(F.coalesce("_count", F.lit(0)), F.col("record_count")), COUNT_MISMATCH)
    )
    judged = joined.withColumn("why", reason)
    bad = F.min(F.when(F.col("why").isNotNull(), F.struct("index", "why")))
    summary = judged.agg(
        F.count(F.lit(1)).alias("entries"), bad.alias("bad"), F.max(F.struct("index", "batch_hash")).alias("head")
    )
    head = F.lit(expected_head).cast("string")
    wrong_head = F.col("bad").isNull() & head.isNotNull() & differs(F.col("head.batch_hash"), head)
    why = (
        F.when(F.col("entries") == 0, MISSING_LOG)
        .when(F.col("bad").isNotNull(), F.col("bad.why"))
        .when(wrong_head, HEAD_MISMATCH)
    )
    return summary.select(
        why.isNull().alias("success"),
        F.coalesce(F.col("bad.index"), F.col("entries")).alias("checked_batches"),
        F.col("bad.index").alias("first_mismatch_index"),
        why.alias("reason"),
    )


def audit_tamper(lines: DataFrame) -> DataFrame:
    """A copy of the log whose first entry claims other metadata."""
    entries = parse_lines(lines)
    first = entries.agg(F.min("seq")).scalar()
    opened = F.regexp_replace("batch_metadata", r"\s*\}\s*$", "")
    comma = F.when(opened.rlike(r"\{\s*$"), "").otherwise(",")
    changed = F.concat(opened, comma, F.lit('"tampered":true}'))
    edited = entries.withColumn(
        "batch_metadata", F.when(F.col("seq") == first, changed).otherwise(F.col("batch_metadata"))
    )
    return to_lines(edited, F.col("ingested_at"))


def integrity_overhead(df: DataFrame, order: Order, loops: int = 5, warmup: int = 1) -> DataFrame:
    """Time of canonical texts alone against canonical texts, hashes and root.

    Both run as whole Spark jobs into a sink that keeps nothing.
    """
    spark = df.sparkSession
    rows = df.count()

    def plain() -> None:
        df.select(F.length(canonical_json(df)).alias("n")).write.format("noop").mode("overwrite").save()

    def hashed() -> None:
        merkle_roots(leaves(df, F.lit("all"), order)).write.format("noop").mode("overwrite").save()

    timings = []
    for i in range(max(0, warmup) + max(1, loops)):
        for mode, run in (("without_integrity", plain), ("with_integrity", hashed)):
            start = time.perf_counter()
            run()
            if i >= warmup:
                timings.append((mode, time.perf_counter() - start))
    measured = spark.createDataFrame(timings, "mode string, seconds double")
    summary = measured.groupBy("mode").agg(
        F.count(F.lit(1)).alias("loops"),
        F.avg("seconds").alias("avg_sec"),
        F.stddev_pop("seconds").alias("std_sec"),
        F.expr("percentile(seconds, 0.5)").alias("median_sec"),
        F.expr("percentile(seconds, 0.75) - percentile(seconds, 0.25)").alias("iqr_sec"),
    )
    plain_median = summary.where(F.col("mode") == "without_integrity").select("median_sec").scalar()
    return summary.withColumns(
        {
            "records": F.lit(rows),
            "throughput_rps": F.lit(float(rows)) / F.col("avg_sec"),
            "median_throughput_rps": F.lit(float(rows)) / F.col("median_sec"),
            "overhead_us_per_record": (F.col("median_sec") - plain_median) * 1e6 / F.greatest(F.lit(rows), F.lit(1)),
        }
    )
