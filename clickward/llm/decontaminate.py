"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A mask such as 110111011 reads some token positions of a window and ignores
the others, so a substituted word under a gap leaves the hash intact. All
masks hash every window of the benchmark items and of the documents; equal
hashes are hits. A hit fixes how an item lies on the document (its diagonal);
each (document, item, diagonal) is then verified once, word by word: how many words
of the whole item agree, and the best stretch of the diagonal, in which an
equal word earns 1 and another costs `MISS`. Stretches of diagonals at most
`SHIFT` apart belong together, so an inserted or deleted word cuts nothing off.
An item is a leak if at least `coverage` of its words agree, on one diagonal or
in stretches that belong together, or if one stretch has `EXCERPT` equal words.

The seed table of the benchmark is broadcast only if it has at most
`BROADCAST_SEEDS` rows; beyond that the seeds are joined by a shuffle.

Words are runs of letters and digits in lower case, so case, punctuation and
line breaks make no difference.

Defined cases: null or empty texts and texts shorter than every mask hold no
leak; an item of fewer words than the shortest mask is reported where all its
words stand in a row;
rows without doc_id or item_id are left out; repeated rows give one row per
(doc_id, item_id), its best place, the first of equal ones; empty tables give
an empty result; further columns are ignored; words are compared as text, so
an equal hash of different words is no leak.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickward.session import materialize

# Read (1) and ignored (0) token positions of each seed.
MASKS = ("111011", "1101101")
COVERAGE = 0.6
# Equal words that make an excerpt a leak, cost of a differing word, diagonals that belong together.
EXCERPT = 20
MISS = 1.5
SHIFT = 8
BROADCAST_SEEDS = 100_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(frame: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """(key, seed, at): a row per window and mask.

    Hashes are made inside the row and only they are exploded, so no output
    row carries the words of its text.
    """
    hashed = frame.select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))

    def windows(number: int, mask: str) -> Column:
        read = [i for i, bit in enumerate(mask) if bit == "1"]
        last = F.size("w") - F.lit(len(mask))
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places,
            lambda at: F.struct(
                F.xxhash64(F.lit(number), *[F.get("w", at + F.lit(i)) for i in read]).alias("seed"), at.alias("at")
            ),
        )

    every = F.flatten(F.array(*[windows(i, m) for i, m in enumerate(masks)]))
    return hashed.select(key, F.explode(every).alias("s")).select(key, "s.seed", "s.at")


def _whole_seeds(items: DataFrame, masks: tuple[str, ...], short: tuple[str, ...]) -> DataFrame:
    """Seeds of the items of exactly as many words as a mask of `short` has, numbered as after `masks`."""
    hashed = items.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    parts = [
        hashed.where(F.size("w") == len(mask)).select(
            "item_id",
            F.xxhash64(F.lit(len(masks) + number), *[F.get("w", F.lit(i)) for i in range(len(mask))]).alias("seed"),
            F.lit(0).alias("at"),
        )
        for number, mask in enumerate(short)
    ]
    return reduce(DataFrame.union, parts)


def best_stretch(same: Column) -> Column:
    """(start, end) of the stretch with the highest score; `same` says of each place whether the words are equal."""

    def step(state: Column, at: Column) -> Column:
        score = F.greatest(state["score"], F.lit(0.0)) + F.when(F.get(same, at), 1.0).otherwise(-MISS)
        start = F.when(state["score"] > 0, state["start"]).otherwise(at)
        better = score > state["best"]
        return F.struct(
            score.alias("score"),
            start.alias("start"),
            F.when(better, score).otherwise(state["best"]).alias("best"),
            F.when(better, start).otherwise(state["a"]).alias("a"),
            F.when(better, at + 1).otherwise(state["b"]).alias("b"),
        )

    zero = F.struct(
        F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0.0).alias("best"), F.lit(0).alias("a"), F.lit(0).alias("b")
    )
    places = F.when(F.size(same) > 0, F.sequence(F.lit(0), F.size(same) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, zero, step, lambda s: F.struct(s["a"].alias("start"), s["b"].alias("end")))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    masks: tuple[str, ...] = MASKS,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(doc_id, item_id, first_word, n_item_words, n_equal): the best verified place of each leaked item."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    shortest = min(len(m) for m in masks)
    # Lengths of items that no mask covers: fewer than the shortest mask has places.
    n_words = F.size(words(F.col("text")))
    lengths = items.select(n_words.alias("n")).where(F.col("n").between(1, shortest - 1)).distinct().collect()
    short = tuple("1" * n for n in sorted(r.n for r in lengths))
    known = seeds(items, "item_id", masks)
    if short:
        known = known.union(_whole_seeds(items, masks, short))
        masks = (*masks, *short)
    item_seeds = materialize(
        known.withColumnRenamed("at", "item_at").distinct(), "benchmark-seeds"
    )
    if item_seeds.count() <= broadcast_seeds:
        item_seeds = F.broadcast(item_seeds)
    hits = materialize(
        seeds(docs, "doc_id", masks)
        .join(item_seeds, "seed")
        .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("first_word"))
        .distinct(),
        "seed-hits",
    )

    item_words = items.select("item_id", words(F.col("text")).alias("item_words"))
    doc_words = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", words(F.col("text")).alias("doc_words")
    )
    laid = hits.join(item_words, "item_id").join(doc_words, "doc_id")
    length = F.size("item_words")
    begin = F.greatest("first_word", F.lit(0))
    width = F.greatest(F.least(F.col("first_word") + length, F.size("doc_words")) - begin, F.lit(0))
    theirs = F.slice("doc_words", begin + 1, width)
    ours = F.slice("item_words", begin - F.col("first_word") + 1, width)
    base = (begin - F.col("first_word")).alias("base")
    compared = laid.select(
        "doc_id", "item_id", "first_word", length.alias("n_item_words"), base, F.zip_with(theirs, ours, lambda a, b: a == b).alias("same")
    )
    equal = F.size(F.filter("same", lambda e: e))
    stretch = compared.withColumn("n_diagonal", equal).withColumn("s", best_stretch(F.col("same")))
    inside = F.transform("same", lambda e, i: F.when(e & (i >= F.col("s.start")) & (i < F.col("s.end")), i + F.col("base")))
    places = stretch.withColumn("places", F.filter(inside, lambda p: p.isNotNull())).drop("same", "s", "base")

    # Neighbouring diagonals of an item in a document are a chain; its stretches count each word of the item once.
    beside = Window.partitionBy("doc_id", "item_id").orderBy("first_word")
    new = (F.col("first_word") - F.lag("first_word").over(beside) > SHIFT).cast("int")
    chained = places.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("chain", F.sum("new").over(beside))
    best_first = F.struct("n_diagonal", -F.col("first_word"))
    joined = chained.groupBy("doc_id", "item_id", "chain").agg(
        F.max_by("first_word", best_first).alias("first_word"),
        F.first("n_item_words").alias("n_item_words"),
        F.max("n_diagonal").alias("n_diagonal"),
        F.max(F.size("places")).alias("n_stretch"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_joined"),
    )
    verified = joined.withColumn("n_equal", F.greatest("n_diagonal", "n_joined"))
    enough = F.col("n_equal") >= F.lit(coverage) * F.col("n_item_words")
    leaks = verified.where(enough | (F.col("n_stretch") >= EXCERPT))
    best = F.max_by(F.struct("first_word", "n_item_words", "n_equal"), F.struct("n_equal", -F.col("first_word")))
    return leaks.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no benchmark item was found."""
    leaked = materialize(contaminated(docs, benchmark).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti")
