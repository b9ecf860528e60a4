"""Spelling variants: words one edit apart, found among the sorted rotations of all words.

A word with a terminator has one rotation per code point and one more. Turned
so that a code point comes last, all before that code point is what the word
is without it: words that differ in this place only share that prefix, and a
word that lacks the code point is that prefix as a whole. So rotations are
sorted by their prefix, and each range of equal prefixes holds words that are
one replacement or one insertion apart. A range has at most one member per
letter of the alphabet and one word without the letter, whatever the corpus.
It is scanned once: every member learns how many others it has and which of
them is the most frequent, no pairs are made. In a run of equal code points
any of them can be the inserted one; only the first counts, so that every
neighbour is counted once.

The rotations of a word are as long as the square of its length. Beyond
`LONG` code points prefixes are therefore replaced by two 64-bit hashes, made
from sums along the word in constant time each; members of equal hashes are
then compared in full as texts.

A word's form is its most frequent neighbour (ties: the first in code-point
order) if that occurs at least `FACTOR` times as often. Forms are followed by
doubling: each step lets every word point where the word it points to points.

Special cases: null and empty texts have no words; words of any length are
whole. Repeated rows count each. A null doc_id is an empty text in the sum
that picks the edited runs. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickward.llm.common import PolyHash, as_long, ascii_lower, mix, whole_text
from clickward.session import materialize

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 6
LEAST_COUNT = 5
EDITED = 199
FACTOR = 5
LONG = 64
# Sorts before every letter and is none.
END = "$"


def edited_runs(docs: DataFrame) -> DataFrame:
    """The runs of letters of all texts in lower case, one code point less where their checksum says so.

    Only runs that can be words are looked at: an edit never lengthens one.
    """
    runs = whole_text(docs).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run")
    )
    run = F.col("run")
    lower = runs.select("doc_id", F.when(run.rlike("[A-Z]"), ascii_lower(run)).otherwise(run).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run)
    h = lower.select("run", F.crc32(named).alias("h"))
    place = (F.col("h") % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + F.lit(2)))
    return h.select(F.when(F.col("h") % EDITED == 0, shorter).otherwise(run).alias("word"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    counts = edited_runs(docs).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _rank() -> Column:
    """Orders words by falling count, then by code points; the least is the best."""
    return F.struct((-F.col("n")).alias("less"), F.col("word"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, lacks, first, rank, word): rotations without their last code point, and whole ones of words that lack it."""
    i, word = F.col("i"), F.col("word")
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))

    def prefix(rest: Column) -> Column:
        return F.concat(rest, F.lit(END), F.substr(word, F.lit(1), i))

    letter, before = F.substr(word, i + F.lit(1), F.lit(1)), F.substr(word, i, F.lit(1))
    without = F.struct(
        prefix(F.substr(word, i + F.lit(2))).alias("prefix"),
        F.lit(False).alias("lacks"),
        ((i == 0) | (letter != before)).alias("first"),
    )
    whole = F.struct(prefix(F.substr(word, i + F.lit(1))).alias("prefix"), F.lit(True).alias("lacks"), F.lit(False).alias("first"))
    both = F.when(i < F.length(word), F.array(without, whole)).otherwise(F.array(whole))
    return turned.select("word", _rank().alias("rank"), F.inline(both))


def scanned(turned: DataFrame) -> DataFrame:
    """(word, near, best): per rotation how many neighbours its range holds, and the best of them."""
    group = Window.partitionBy("prefix")
    along = Window.partitionBy("prefix", "lacks").orderBy("rank")
    has, rank = ~F.col("lacks"), F.col("rank")
    seen = turned.select(
        "word",
        "lacks",
        "first",
        F.row_number().over(along).alias("place"),
        F.lead("rank").over(along).alias("second"),
        F.count_if(has).over(group).alias("have"),
        F.count_if("first").over(group).alias("firsts"),
        F.count_if("lacks").over(group).alias("lack"),
        F.min(F.when(has, rank)).over(group).alias("best_having"),
        F.min(F.when(F.col("first"), rank)).over(group).alias("best_first"),
        F.min(F.when(F.col("lacks"), rank)).over(group).alias("lacking"),
    )
    other = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("best_having"))
    lacking = F.when(F.col("first"), F.col("lacking"))
    return seen.select(
        "word",
        F.when(F.col("lacks"), F.col("firsts"))
        .otherwise(F.col("have") - 1 + F.when(F.col("first"), F.col("lack")).otherwise(0))
        .alias("near"),
        F.when(F.col("lacks"), F.col("best_first")).otherwise(F.least(other, lacking)).alias("best"),
    ).where(F.col("near") > 0)


def _hashed_rotations(words: DataFrame) -> DataFrame:
    """The rotations of long words, their prefixes as two hashes; `i` is the place of the code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [PolyHash(101), PolyHash(202)]
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lacks", pa.bool_()), ("i", pa.int32()), ("id", pa.string())])
        for batch in batches:
            for word, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(word.encode(), np.uint8)
                starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                letters = np.array(list(word))
                keys = []
                for h in hashes:
                    sums = h.prefix(data)
                    head = h.between(sums, np.zeros(len(starts), np.int64), starts)
                    tail = h.between(sums, starts, np.full(len(starts), len(data)))
                    less = mix(tail[1:] * np.uint64(3) + mix(head[:-1]))
                    keys.append((less, mix(tail * np.uint64(3) + mix(head))))
                first = np.append(True, letters[1:] != letters[:-1])
                # A place within a run of equal code points never stands for an insertion.
                at = np.arange(len(letters), dtype=np.int32)
                for lacks, side, places in ((False, 0, np.where(first, at, -1 - at)), (True, 1, np.arange(len(starts)))):
                    ids = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(places), np.int32)), [name]).cast(pa.string())
                    cols = [as_long(keys[0][side]), as_long(keys[1][side]), np.full(len(places), lacks), places.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), ids], schema=schema)

    return words.select("word", "id").mapInArrow(run, "a long, b long, lacks boolean, i int, id string")


def long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near, best) for neighbours of which one is longer than `LONG` code points."""
    longer = words.where(F.length("word") >= LONG).withColumn("id", F.sha2("word", 256))
    turned = _hashed_rotations(longer)
    left, right = turned.alias("l"), turned.alias("r")
    same = (F.col("l.a") == F.col("r.a")) & (F.col("l.b") == F.col("r.b")) & (F.col("l.id") != F.col("r.id"))
    # Replacements: both ranges without their code point. Insertions: a first code point against a word that lacks it.
    kind = ~F.col("l.lacks") & (~F.col("r.lacks") | (F.col("l.i") >= 0))
    place = F.when(F.col("l.i") < 0, -1 - F.col("l.i")).otherwise(F.col("l.i"))
    pairs = left.join(right, same & kind).select(
        F.col("l.id").alias("id"), F.col("r.id").alias("other_id"), place.alias("i"), F.col("r.lacks").alias("lacks")
    )
    other = longer.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = pairs.join(longer, "id").join(other, "other_id")

    def cut(text: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), F.col("i")), F.substr(text, F.col("i") + F.lit(2)))

    equal = F.when(F.col("lacks"), cut(F.col("word")) == F.col("other")).otherwise(cut(F.col("word")) == cut(F.col("other")))
    real = both.where(equal & (F.greatest(F.length("word"), F.length("other")) > LONG))
    here = F.struct((-F.col("n")).alias("less"), F.col("word"))
    there = F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))
    forth = F.struct(F.col("word"), F.lit(1).cast("long").alias("near"), there.alias("best"))
    back = F.struct(F.col("other").alias("word"), F.lit(1).cast("long").alias("near"), here.alias("best"))
    # A replacement is met from both sides, an insertion from the longer word only.
    return real.select(F.inline(F.when(F.col("lacks"), F.array(forth, back)).otherwise(F.array(forth))))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of every word with a neighbour."""
    short = scanned(rotations(words.where(F.length("word") <= LONG)))
    each = short.unionByName(long_neighbours(words))
    return each.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms from each word that has one.

    A form occurs more often by a factor, so chains are no longer than the logarithm of the corpus.
    """
    points = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = points.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(points.join(onward, "root", "left"), "spelling-roots")
        points = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where(F.col("next").isNotNull()).isEmpty():
            return points


def spelling_groups(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = materialize(word_counts(docs), "spelling-words")
    best = F.col("best")
    near = words.join(neighbours(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    often = -best["less"] >= FACTOR * F.col("n")
    found = materialize(
        near.select("word", "n", "n_near", F.when(often, best["word"]).alias("form"), F.when(often, -best["less"]).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(found.where(F.col("form").isNotNull()))
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
