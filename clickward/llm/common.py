"""Helpers that several corpus operators share: safe inputs and byte-level hashing inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = r"[\x20\x09-\x0D]"
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without nulls in text; all other columns, whatever their names, are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    counter = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(counter) | np.uint64(1)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class PolyHash:
    """Hashes of any substrings of a byte buffer in constant time each, modulo 2^64."""

    def __init__(self, seed: int):
        self._bytes = constants(seed, 256)
        self._base = constants(seed + 1, 1)[0]
        self._inverse = np.uint64(pow(int(self._base), -1, 1 << 64))
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self._up) < n:
            step = np.uint64(pow(int(self._base), len(self._up), 1 << 64))
            back = np.uint64(pow(int(self._inverse), len(self._down), 1 << 64))
            self._up = np.concatenate([self._up, self._up * step])
            self._down = np.concatenate([self._down, self._down * back])

    def prefix(self, buffer: np.ndarray) -> np.ndarray:
        n = len(buffer)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self._bytes[buffer] * self._up[:n], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of buffer[start:end]; equal bytes give equal hashes wherever they are."""
        return mix((prefix[end] - prefix[start]) * self._down[start])


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(record batch slice, bytes of its texts, text offsets) with about `size` bytes each.

    A text is never cut: one longer than `size` makes a chunk of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        wide = text.cast(pa.large_string())
        offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
        data = wide.buffers()[2]
        every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(wide):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
            to = min(to, len(wide))
            yield batch.slice(row, to - row), every[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
            row = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_bounds(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words the texts before text i have (one more entry than texts)."""
    n = len(buffer)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[buffer]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = first | ~solid[:-1]
    starts = np.flatnonzero(solid[1:] & edge)
    ends = np.flatnonzero(solid[:-1] & (first | ~solid[1:]))
    return starts, ends, np.searchsorted(starts, offsets)
