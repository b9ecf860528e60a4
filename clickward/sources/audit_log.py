"""The audit log on shared storage: one folder per entry, and its record hashes.

    <log>/entries/seq=<n>/   one JSON line
    <log>/leaves/seq=<n>/    Parquet of (batch_id, pos, record_hash)

Entries are numbered by the log itself. A batch that is appended again right
after itself, as a replayed micro-batch is, adds nothing; no entry is ever
replaced, and a new stream on an old log continues its chain.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clickward.functions.hashing import GENESIS
from clickward.operators.audit import audit_chain, audit_verify, leaves, merkle_root, parse_lines, to_lines
from clickward.operators.ordering import Order
from clickward.session import SkewPolicy, materialize

LINES_SCHEMA = "line string, seq bigint"
LEAVES_SCHEMA = "batch_id string, pos bigint, record_hash string, seq bigint"


def _read(reader, path: str, spark: SparkSession, schema: str) -> DataFrame:
    try:
        return reader(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, log: str) -> DataFrame:
    """(line, seq) of all entries; empty when there is no log."""
    raw = _read(spark.read.text, f"{log}/entries", spark, "value string, seq bigint")
    return raw.select(F.col("value").alias("line"), F.col("seq").cast("bigint").alias("seq"))


def read_leaves(spark: SparkSession, log: str) -> DataFrame:
    return _read(spark.read.parquet, f"{log}/leaves", spark, LEAVES_SCHEMA)


def _newest(spark: SparkSession, log: str) -> int:
    """Number of the newest entry by the names in one folder; -1 without any."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{log}/entries")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return max((int(name.removeprefix("seq=")) for name in names if name.startswith("seq=")), default=-1)


def last_entry(spark: SparkSession, log: str) -> Row | None:
    """The newest entry; only its own line is read."""
    number = _newest(spark, log)
    if number < 0:
        return None
    line = spark.read.text(f"{log}/entries/seq={number}").select(F.lit(number).alias("seq"), F.col("value").alias("line"))
    return parse_lines(line).first()


def append_batch(
    df: DataFrame,
    log: str,
    batch_id: str,
    metadata: Column,
    order: Order,
    policy: SkewPolicy | None = None,
) -> int:
    """Hash all records of a batch, chain one entry to the log and return its number.

    `metadata` is a JSON text. One writer appends at a time, as the chain needs.
    If the newest entry already holds this batch id with this root and count,
    it is left as it is. Record hashes without an entry are those of an append
    that never ended, and give way.
    """
    spark = df.sparkSession
    newest = last_entry(spark, log)
    number = newest["seq"] + 1 if newest else 0
    target = f"{log}/leaves/seq={number}"
    leaves(df, F.lit(batch_id), order, policy=policy).write.mode("overwrite").parquet(target)
    root = materialize(merkle_root(spark.read.parquet(target)), "root")
    if newest and newest["batch_id"] == batch_id:
        again = root.first()
        if (again["merkle_root"], again["record_count"]) == (newest["merkle_root"], newest["record_count"]):
            _delete(spark, target)
            return newest["seq"]
    header = root.select(
        F.lit(number).alias("seq"),
        F.lit(batch_id).alias("batch_id"),
        "record_count",
        "merkle_root",
        metadata.alias("batch_metadata"),
    )
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    previous = newest["batch_hash"] if newest else GENESIS
    line = to_lines(audit_chain(header, previous), now).select("line")
    line.coalesce(1).write.mode("errorifexists").text(f"{log}/entries/seq={number}")
    return number


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def verify_log(spark: SparkSession, log: str, expected_head: str | None = None, policy: SkewPolicy | None = None) -> DataFrame:
    return audit_verify(read_lines(spark, log), read_leaves(spark, log), expected_head, policy)
