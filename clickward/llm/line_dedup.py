"""Line dedup with levelled sorted runs of line hashes.

The store keeps runs of (line key, documents, largest document), each sorted by
key. A new batch is counted, merge-anti-joined with what the runs already
settle, and the rest is added as a run of level 0. When a level holds `fan`
runs they are compacted into one run of the next level, so a batch meets
O(log batches) runs. A key is settled once it has `min_docs` documents and a
holder above every document of the batch: nothing in the batch can change what
it means. Batches come in descending document order, so most repeats settle
early, but the result does not depend on the order.

Defined cases: a null or empty text is one empty line; short lines always
stay; a key repeated in one document counts once and its lines share one fate;
repeated rows of one doc_id count as one document; a row without doc_id is no
document and keeps its lines; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickward.llm.common import ascii_lower, whole_text
from clickward.session import materialize

KEY = ["h1", "h2"]
SPACES = " \t\n\x0b\x0c\r"


def line_keys(docs: DataFrame, min_length: int = 20) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2) of every line that is long enough to be compared."""
    lines = whole_text(docs).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    key = ascii_lower(F.trim(F.col("line"), F.lit(SPACES)))
    return (
        lines.select("doc_id", "text_key", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_length)
        .select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


class LineRuns:
    """Levelled store of sorted runs; `levels[i]` lists the runs of level i."""

    def __init__(self, min_docs: int = 3, fan: int = 3):
        self.min_docs, self.fan = min_docs, fan
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, run: DataFrame) -> DataFrame:
        return materialize(run.repartitionByRange(*KEY).sortWithinPartitions(*KEY), "line-run")

    def merged(self) -> DataFrame | None:
        """All runs as one: a row per key."""
        runs = [run for level in self.levels for run in level]
        return _merge(runs) if runs else None

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (doc_id, h1, h2) whose documents no earlier batch had."""
        own = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("top"))
        known = self.merged()
        if known is not None:
            settled = known.where(F.col("docs") >= self.min_docs).select(*KEY, F.col("top").alias("known_top"))
            same = [own[k] == settled[k] for k in KEY]
            own = own.join(settled, [*same, settled["known_top"] >= own["top"]], "left_anti")
        self.levels[0].append(self._write(own))
        self._compact()

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fan:
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(_merge(self.levels[depth])))
                self.levels[depth] = []

    def common(self) -> DataFrame:
        """(h1, h2, top) of the keys found in at least `min_docs` documents."""
        return self.merged().where(F.col("docs") >= self.min_docs).select(*KEY, "top")


def _merge(runs: list[DataFrame]) -> DataFrame:
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return every.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))


def _keep_lines(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, dropped in parts:
        yield pd.Series(
            [
                text if gone is None else "\n".join(_others(text.split("\n"), set(gone)))
                for text, gone in zip(texts, dropped, strict=True)
            ],
            dtype=object,
        )


def _others(lines: list[str], gone: set[int]) -> list[str]:
    return [line for i, line in enumerate(lines) if i not in gone]


def dedup_lines(
    docs: DataFrame, min_docs: int = 3, min_length: int = 20, batches: int = 4, fan: int = 3, also: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) and the columns `also` of every row of `docs`."""
    keys = line_keys(docs, min_length)
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, width = span["low"] or 0, ((span["high"] or 0) - (span["low"] or 0)) // batches + 1
    batch = (F.floor((F.col("doc_id") - low) / width)).cast("int").alias("batch")
    lines = materialize(keys.select("*", batch), "line-keys")

    store = LineRuns(min_docs, fan)
    for number in reversed(range(batches)):
        store.add(lines.where(F.col("batch") == number))

    # Written first, so that the join below reads two plain shuffles and a hot line's rows can be split.
    common = materialize(store.common(), "common-lines")
    drops = (
        lines.join(common, KEY)
        .where(F.col("doc_id") < F.col("top"))
        .select("doc_id", "text_key", "pos")
        .distinct()
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list("pos").alias("dropped"))
    )
    keep = F.pandas_udf(_keep_lines, "string")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)
    rows = texts.withColumn("text_key", F.xxhash64("text")).join(drops, ["doc_id", "text_key"], "left")
    return rows.select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        keep("text", "dropped").alias("kept_text"),
        *also,
    )
