"""Digests of files by their bytes, read in parallel.

A file is cut into blocks of fixed length, whatever the cluster. A file of one
block has the SHA-256 of its bytes. A longer one has a tree: its nodes are the
digests of its blocks, and as long as there is more than one, every `FAN`
neighbours become the SHA-256 of their hexadecimal digests in order. So the
digest depends on the bytes and their order alone, a file of any size is read
by many tasks, and no task holds more than one chunk of bytes or `FAN` digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
FAN = 1024
# Most tasks that read at a time; each of them takes blocks one after the other.
READERS = 10_000


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of every input file that holds a byte, from the file system's metadata alone."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _open(uri: str):
    """A file for random access, by the file systems that Arrow knows."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        local = uri.removeprefix("file:")
        return fs.LocalFileSystem().open_input_file("/" + local.lstrip("/"))
    system, inside = fs.FileSystem.from_uri(quote(uri, safe="/:@?&=%"))
    return system.open_input_file(inside)


def _block_digest(uri: str, start: int, length: int) -> str:
    digest = hashlib.sha256()
    with _open(uri) as data:
        data.seek(start)
        while length:
            chunk = data.read(min(CHUNK_BYTES, length))
            if not chunk:
                raise ValueError(f"{uri} became shorter while it was read")
            digest.update(chunk)
            length -= len(chunk)
    return digest.hexdigest()


def file_digests(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(path, bytes, sha256) of every file; empty files are no part of a listing.

    Files must keep their bytes while they are read. Executors open them through Arrow, so the scheme must be one that Arrow
    knows: local or shared folders, HDFS and the usual object stores.
    """
    listed = file_listing(spark, path).select("path", "bytes")
    size = listed.agg(
        F.sum(F.ceil(F.col("bytes") / block_bytes)).alias("blocks"), F.max(F.ceil(F.col("bytes") / block_bytes)).alias("most")
    ).first()
    last = (F.ceil(F.col("bytes") / block_bytes) - 1).cast("long")
    blocks = listed.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), last)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [
                _block_digest(r["path"], r["node"] * block_bytes, min(block_bytes, r["bytes"] - r["node"] * block_bytes)) for r in rows
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    # A fixed number, as these rows are tiny and the work behind them is not.
    spread = blocks.repartition(min(READERS, size["blocks"] or 1), "path", "node")
    nodes = spread.mapInArrow(read, "path string, bytes long, node long, sha256 string")
    left = size["most"] or 1
    while left > 1:
        neighbours = F.sort_array(F.collect_list(F.struct("node", "sha256")))
        level = nodes.groupBy("path", "bytes", F.floor(F.col("node") / fan).alias("up")).agg(neighbours.alias("below"))
        # The file is at its root already if this is its only node.
        root = (F.col("up") == 0) & (F.size("below") == 1)
        joined = F.sha2(F.array_join(F.col("below.sha256"), ""), 256)
        nodes = level.select("path", "bytes", F.col("up").alias("node"), F.when(root, F.col("below")[0]["sha256"]).otherwise(joined).alias("sha256"))
        left = -(-left // fan)
    return nodes.select("path", "bytes", "sha256")
