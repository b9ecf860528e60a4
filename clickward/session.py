"""Session building, the shared scratch folder and the limits that keep tasks small."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "clickward",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    kafka_package: str | None = None,
    **conf: str,
) -> SparkSession:
    """Session with a fixed UTC clock and adaptive execution.

    `master` and `shuffle_partitions` stay unset on a cluster, where the submit
    command and the cluster defaults decide. `kafka_package` is the Maven name
    of the Kafka connector, needed only by the Kafka source.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if kafka_package:
        builder = builder.config("spark.jars.packages", kafka_package)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Fixed value: the longest method, in bytes of code, that HotSpot compiles.
COMPILED_BYTES = "8000"


def compiled_stages(spark: SparkSession) -> None:
    """Keep Spark from fusing wide stages into methods that the JVM only interprets, where the session has no limit of its own.

    Spark's default limit is the largest method there is. Above the JVM's own limit a stage of many columns runs several
    times slower than the same operators one after the other.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit) == "65535":
        spark.conf.set(limit, COMPILED_BYTES)


_LOCAL_SCRATCH: list[str] = []


def allow_local_scratch(spark: SparkSession) -> None:
    """Let a local session without `spark.checkpoint.dir` use a temporary folder of this machine.

    For tests, the bench and queries run by hand; library code never calls it.
    """
    if _LOCAL_SCRATCH or spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local"):
        return
    _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="clickward-"))
    atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can read: the session's `spark.checkpoint.dir`."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not _LOCAL_SCRATCH:
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
    return _LOCAL_SCRATCH[0]


def _owned(spark: SparkSession) -> str:
    """The application owns what it writes: one folder per application id."""
    return f"{scratch_root(spark)}/clickward/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the application's scratch folder."""
    return f"{_owned(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; frames that read them end with it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_owned(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that nothing reads any more."""
    if not path.startswith(_owned(spark)):
        raise ValueError(f"{path} is no scratch table of this application")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize_at(df, path: str):
    """Write a frame to a scratch path and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df, name: str = "frame"):
    """Write a frame to the scratch folder and read it back.

    Cuts the lineage with a table that survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class SkewPolicy:
    """Limits on what one task or one broadcast may hold.

    A group above `max_group_rows` is cut into slices of its own order. The
    limit grows with the data only so far that at most `max_slices` groups can
    exceed it. A lookup table is broadcast only when it was counted and has at
    most `broadcast_rows` rows.
    """

    max_group_rows: int = 2_000_000
    max_slices: int = 4096
    broadcast_rows: int = 200_000

    @classmethod
    def of(cls, spark: SparkSession) -> "SkewPolicy":
        def read(name: str, default: int) -> int:
            return int(spark.conf.get(f"spark.clickward.{name}", str(default)))

        return cls(
            read("maxGroupRows", cls.max_group_rows),
            read("maxSlices", cls.max_slices),
            read("broadcastRows", cls.broadcast_rows),
        )

    def group_limit(self, rows: int) -> int:
        return max(self.max_group_rows, -(-rows // self.max_slices))


