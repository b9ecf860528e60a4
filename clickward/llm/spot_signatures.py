"""Document fingerprints from spot signatures, with DataFrame functions only.

An anchor is a word that is common in its language, like an article. Each
anchor makes one signature: itself and the next two content words, common words
between them skipped. Prose has many common words, navigation, lists and
numbers have few, so a text is known by its running prose. Where `GAP` words
in a row hold no common word (tables, other languages, the start of a text),
every word is an anchor, and the first `GAP` content words of a text are
signatures by themselves, so that short texts have several. The rule looks at
`GAP` words before and `REACH` words after a place only: a change in one part
of a text leaves the signatures of the others alone.

A fingerprint is the set of a text's signatures, eight hexadecimal digits of
the MD5 each, sorted and written one after the other. The likeness of two
fingerprints is the Jaccard similarity of the sets. `near_fingerprints` finds
all pairs above a limit: sets are partitioned by length, so that a set meets
only its own and the next longer partition, and inside of them only through
its rarest signatures, as many as a similar set cannot avoid altogether.

`compared` holds every document against an edited form of itself, whose last
quarter is the start of the next document, and against the next document. The
next is found among the ids, in slices of their order if they are many; texts
are moved once, by a key of id and text.

Special cases: null texts are empty. Texts without words (empty, or nothing
but spaces and ASCII punctuation) have an empty fingerprint, which is like
another empty one and unlike all others. Words are split at ASCII characters
that are no letters or digits; texts of any length are whole. Null doc_ids
come first in the order, doc_ids that tie follow a digest of their texts, and
rows that repeat id and text share one place in the order, each keeping its
row. A single document is its own next. Further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickward.llm.common import whole_text
from clickward.operators.ordering import drop_helpers, neighbour, number_order, split_groups
from clickward.session import SkewPolicy, materialize

# Common words of four languages.
COMMON = (
    "the of and a to in is that it was for on are with as be this have from or by at not but an they he she you we "
    "der die das und ist nicht ein eine zu den mit von sich auf für dem des im auch es an als aus bei nach wird "
    "le la les un une des et est que qui dans en du pour pas sur au avec par ce il elle ne se plus sont ou "
    "el los las una y que del se por con no para su al como lo más pero sus o fue ha son"
).split()

WORD = r"[^\x00-/:-@\[-`{-\x7F]+"
REACH = 8
GAP = 8
DIGITS = 8
# Ids that one task puts in order at a time.
SLICE_ROWS = 25_000
# Documents take this share of the next one's start in the edited text.
EDIT = 4
NEAR = 0.75


def with_signatures(texts: DataFrame, text: str = "text", out: str = "signatures") -> DataFrame:
    """Add the sorted set of a text's signatures.

    Words and content words are columns of their own on the way, so that each is made once.
    """
    words, content = f"{out}_words", f"{out}_content"

    def at(i: Column) -> Column:
        """Content word i, null where the word is common or the text ends; a slice would copy the whole list each time."""
        return F.get(F.col(content), i)

    def common_before(i: Column) -> Column:
        return functools.reduce(Column.__or__, [(i >= d) & at(i - d).isNull() for d in range(1, GAP + 1)])

    def second(i: Column) -> Column:
        """The content word after the next one; evaluated only as far as the words are common."""
        out = F.lit(None).cast("string")
        for d in range(REACH - 1, 0, -1):
            out = F.when(at(i + d).isNotNull(), F.coalesce(*[at(i + k) for k in range(d + 1, REACH + 1)])).otherwise(out)
        return out

    def chain(word: Column, i: Column) -> Column:
        onward = F.coalesce(*[at(i + d) for d in range(1, REACH + 1)])
        return F.when(at(i).isNull() | ~common_before(i), digits(F.concat_ws(" ", word, onward, second(i))))

    def digits(value: Column) -> Column:
        return F.substring(F.md5(value), 1, DIGITS)

    first = F.transform(F.slice(F.array_compact(content), 1, GAP), digits)
    chains = F.array_compact(F.transform(words, chain))

    return (
        texts.withColumn(words, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
        .withColumn(content, F.transform(words, lambda w: F.when(~w.isin(COMMON), w)))
        .withColumn(out, F.array_sort(F.array_distinct(F.concat(first, chains))))
        .drop(words, content)
    )


def fingerprint(signatures: str) -> Column:
    return F.array_join(signatures, "")


def _unpacked(packed: str) -> Column:
    """The signatures of a fingerprint that was packed into bytes for a shuffle."""
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def length_part(size: Column, limit: float = NEAR) -> Column:
    """Partition of a set by its length: sets that can reach the limit lie in the same or in adjacent ones."""
    width = math.log(1 / limit) * (1 + 1e-9)
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / width)).otherwise(-1).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a place in the order: id, then a digest of id and text."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    return whole_text(docs).select(
        "doc_id",
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
        F.md5(name).alias("key"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("place"),
    )


def following(keyed: DataFrame) -> DataFrame:
    """(key, next_key, take) of every different row: the next one in the order, after the last the first."""
    rows = materialize(keyed.select("place", "key", "n_chars").distinct(), "spot-order")
    order = number_order("place", "key")
    policy = SkewPolicy.of(rows.sparkSession)
    policy = replace(policy, max_group_rows=min(SLICE_ROWS, policy.max_group_rows))
    parted, groups = split_groups(rows, [], order, policy)
    found = drop_helpers(neighbour(parted, groups, order, "key", "next_key", following=True, policy=policy))
    first = rows.agg(F.min_by("key", F.struct("place", "key")).alias("key")).first()["key"]
    next_key = F.coalesce("next_key", F.lit(first).cast("string"))
    return found.select("key", next_key.alias("next_key"), F.floor(F.col("n_chars") / EDIT).cast("int").alias("take"))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited forms, and how near these and the next document are."""
    keyed = _keyed(docs)
    links = materialize(following(keyed), "spot-next")
    # Counts repeated rows. Both readers of these rows take the same columns and the count, so that they share one
    # exchange and signatures are made once.
    running = Window.partitionBy("key").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.unhex(fingerprint("signatures"))
    signed = with_signatures(keyed.drop("place")).withColumn("packed", packed).drop("signatures")
    placed = signed.withColumn("copy", F.count(F.lit(1)).over(running))
    wanted = links.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), "take")
    given = placed.where("copy = 1").join(wanted, "key")
    given = given.select(
        F.col("for_key").alias("key"),
        "take",
        F.substr("text", F.lit(1), F.least("take", F.col("n_chars").cast("int"))).alias("head"),
        F.col("packed").alias("next_packed"),
        F.col("doc_id").alias("next_doc_id"),
    )
    whole = placed.where("copy >= 1").join(given, "key")
    kept = F.substr("text", F.lit(1), (F.col("n_chars") - F.col("take")).cast("int"))
    edited = with_signatures(whole.withColumn("edited", F.concat(kept, "head")), "edited", "edited_signatures")
    edited = edited.withColumns({"signatures": _unpacked("packed"), "next_signatures": _unpacked("next_packed")})
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("signatures").alias("fingerprint"),
        fingerprint("edited_signatures").alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"),
        "next_doc_id",
        F.size("signatures").cast("long").alias("n_signatures"),
        length_part(F.size("signatures")).alias("length_part"),
    )


def near_fingerprints(docs: DataFrame, limit: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id), and links (class_id, other_id, likeness) of at least `limit`.

    A class is all documents of one fingerprint, named by the smallest doc_id. Links are between different
    classes with signatures, each once, class_id the smaller.
    """
    prints = with_signatures(whole_text(docs)).select("doc_id", "signatures", fingerprint("signatures").alias("name"))
    prints = materialize(prints.withColumn("name", F.sha2("name", 256)), "spot-prints")
    names = prints.groupBy("name").agg(F.min("doc_id").alias("class_id"))
    member = prints.select("doc_id", "name").join(names, "name").select("doc_id", "class_id")
    size = F.size("signatures")
    classes = prints.where(size > 0).groupBy("name").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures"))
    classes = materialize(classes.select("class_id", "signatures", size.alias("size"), length_part(size, limit).alias("part")), "spot-classes")

    # The rarest signatures first: of two similar sets, one of the first n - ceil(limit * n) + 1 is shared.
    each = classes.select("class_id", "size", "part", F.explode("signatures").alias("signature"))
    often = each.groupBy("signature").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rare = Window.partitionBy("class_id").orderBy("shared_by", "signature")
    ranked = each.join(often, "signature", "left").withColumn("shared_by", F.coalesce("often", F.lit(1)))
    ranked = ranked.withColumn("rank", F.row_number().over(rare))
    needed = F.col("size") - F.ceil(F.col("size") * F.lit(limit) - F.lit(1e-9)) + 1
    # Signatures of one class only take their rank but meet nobody.
    index = materialize(ranked.where(F.col("rank") <= needed).where("shared_by > 1").select("signature", "part", "class_id", "size"), "spot-index")

    longer = index.select(
        "signature",
        F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"),
        F.col("part").alias("own_part"),
        F.col("class_id").alias("other_id"),
        F.col("size").alias("other_size"),
    )
    ordered = (F.col("own_part") > F.col("part")) | (F.col("class_id") < F.col("other_id"))
    fits = F.least("size", "other_size") >= F.lit(limit) * F.greatest("size", "other_size") - 1e-9
    candidates = index.join(longer, ["signature", "part"]).where(ordered & fits).select("class_id", "other_id").distinct()
    left = classes.select("class_id", "signatures")
    right = classes.select(F.col("class_id").alias("other_id"), F.col("signatures").alias("other_signatures"))
    both = candidates.join(left, "class_id").join(right, "other_id")
    found = both.select("class_id", "other_id", likeness("signatures", "other_signatures").alias("likeness"))
    small, large = F.least("class_id", "other_id").alias("class_id"), F.greatest("class_id", "other_id").alias("other_id")
    return member, found.where(F.col("likeness") >= limit).select(small, large, "likeness")
