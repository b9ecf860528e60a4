"""Reading, generating and sampling raw click events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickward.sources.digests import file_digests, file_listing

# The raw event's columns, all text.
EVENT_COLUMNS = (
    "click_time",
    "ip",
    "app",
    "device",
    "os",
    "channel",
    "is_fraud",
    "is_attributed",
    "attributed_time",
)


def event_schema(*extra: T.StructField) -> T.StructType:
    return T.StructType([*extra, *[T.StructField(c, T.StringType(), True) for c in EVENT_COLUMNS]])


def read_csv_header(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the file's header."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_csv_events(spark: SparkSession, path: str) -> DataFrame:
    """The nine event columns by name, in fixed order; absent ones are NULL.

    Columns bind by header name, so a file in another column order is read right.
    """
    raw = read_csv_header(spark, path)
    return raw.select(
        *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in EVENT_COLUMNS]
    )


def with_row_ids(df: DataFrame, out: str = "event_id") -> DataFrame:
    """Unique row ids for a frame that has none.

    Apply directly above a file scan: the id is made of the scan's partition
    and the row in it, which a retried task finds again.
    """
    return df if out in df.columns else df.withColumn(out, F.monotonically_increasing_id())


def first_rows(df: DataFrame, limit: int | None, ts: str, tie: str) -> DataFrame:
    """At most `limit` rows, the first in the order of a time given as text and an id; 0 or None keeps all.

    A row cap may be far above what one task can sort: the last row of the cut
    is searched by counts of time and id digits, and the cut is a filter.
    """
    if not limit or limit <= 0:
        return df
    from clickward.operators.sampling import first_places

    moment = F.unix_micros(F.col(ts).try_cast("timestamp")) + F.lit(2**62)
    digits = F.lpad(F.hex(F.coalesce(moment, F.lit(0))), 16, "0")
    if dict(df.dtypes)[tie] in ("bigint", "int"):
        digits = F.concat(digits, F.lpad(F.hex(F.col(tie).cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    return first_places(df, limit, digits, tie)


def decode_json(df: DataFrame, payload: str = "value", *keep: str) -> DataFrame:
    """Message bytes to the nine text columns; unreadable messages give NULLs."""
    parsed = F.from_json(F.col(payload).cast("string"), event_schema())
    return df.select(*keep, parsed.alias("event")).select(*keep, "event.*")


def encode_json(df: DataFrame, out: str = "value", *keep: str) -> DataFrame:
    """The nine columns as one JSON text, NULL fields included."""
    payload = F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"})
    return df.select(*keep, payload.alias(out))


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, offsets: str = "latest") -> DataFrame:
    """A topic of JSON events as a stream. Needs the Kafka connector on the class path.

    A message's place in the topic is its row id.
    """
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offsets)
        .load()
    )
    position = (F.col("offset") * 65_536 + F.col("partition")).alias("event_id")
    return decode_json(messages.select(position, "value"), "value", "event_id")


def read_file_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """A folder of CSV files with headers as a stream."""
    reader = spark.readStream.schema(schema or event_schema()).option("header", True).option("enforceSchema", False)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)


def file_manifest(spark: SparkSession, path: str, source: str = "user_provided", content: DataFrame | None = None) -> DataFrame:
    """One row per input file: size, digest, source and kind.

    The digest is that of the file's bytes, see `file_digests`. Where executors cannot open the files through Arrow, give the
    dataset's rows with `_metadata`, as any file reader gives them, as `content`: the digest is then the SHA-256 over sums of
    its row digests' parts, which tells nothing about bytes that hold no values.
    """
    name = F.element_at(F.split("path", "/"), -1)
    mode = (
        F.when(F.lit(source) == "synthetic_fallback", "fallback_synthetic")
        .when(name.startswith("sample_"), "sample")
        .otherwise("full")
    )
    described = [name.alias("file"), "bytes", F.lit(source).alias("source"), mode.alias("mode")]
    if content is None:
        return file_digests(spark, path).select(*described, "sha256")
    listed = file_listing(spark, path).select(*described)
    row = F.sha2(F.to_json(F.struct(*content.columns), {"ignoreNullFields": "false"}), 256)
    digests = content.select(F.col("_metadata.file_name").alias("file"), row.alias("row"))
    parts = [F.sum(F.conv(F.substring("row", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    by_file = digests.groupBy("file").agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts), 256).alias("sha256"))
    return listed.join(by_file, "file", "left")


def with_column_schema(manifest: DataFrame, data: DataFrame) -> DataFrame:
    """Add the dataset's columns and types to each manifest row."""
    fields = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in data.dtypes]
    )
    return manifest.withColumn("column_schema", F.to_json(fields))
