"""MinHash near-dedup with tensored banding.

A document's set is its distinct word shingles. Instead of L independent
tables of K minhashes each, there are `COLLECTIONS` small collections of
`ROWS` minhashes, and a table is a pair of collections: 16 collections of two
give 120 tables of four from 32 minhashes instead of 480. A pair of documents
at similarity s meets in a table when two collections agree, so at 0.75 it is
missed with probability below 4e-5.

Documents with equal sets are one class first. A collection value that only
one class has can be in no shared table and is left out before the tables are
made. Every bucket proposes partners: its hub, the class with the most company
over all collections (in a family of edited copies that is the text they come
from); the same among the classes of other components; and in small buckets
the next classes by id. In each of `ROUNDS` rounds a class is compared with the
untried partners of other components that its buckets propose most. That joins
the large families at a few pairs a class; labels then converge, and every pair
of a table that still lies in two components is compared, whatever the size of
its bucket. A pair that shares several tables counts in the first of them only.
Sizes and parity bitmaps of the sets rule out pairs that cannot be similar
enough; both bounds are exact. Every link is confirmed on the full sets.
Components come from repeated minimum labels over the confirmed links.

Defined cases: a null, empty or blank text has the empty set and is linked
with nothing; a text with fewer words than a shingle has the whole sequence as
its one element; an equal row given twice comes back twice with one component;
rows without doc_id are left out; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickward.llm.common import LOWER, PolyHash, as_long, chunks, constants, mix, whole_text, word_bounds
from clickward.session import materialize

SHINGLE = 5
SIMILARITY = 75
COLLECTIONS = 16
ROWS = 2
ROUNDS = 4
SMALL = 64
NEIGHBOURS = 4
PROPOSALS = 16
PARTNERS = 4
# Classes of one bucket that a task compares with as many others at a time, and bits of a set's bitmap.
BLOCK = 512
BITMAP = 1024
BROADCAST_IDS = 1_000_000

_WORDS = PolyHash(101)
_PLACE = constants(103, SHINGLE + 1)
_MINHASH = constants(107, COLLECTIONS * ROWS)


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted shingle hashes of every text of a chunk."""
    buffer = LOWER[buffer]
    starts, ends, first = word_bounds(buffer, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    words = _WORDS.between(_WORDS.prefix(buffer), starts, ends)
    n = len(words) - SHINGLE + 1
    rolled = mix(sum(words[j : n + j] * _PLACE[j] for j in range(SHINGLE))) if n > 0 else words[:0]
    found = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            found.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.append(words[a:b], np.uint64(b - a)) * np.append(_PLACE[: b - a], _PLACE[SHINGLE])
            found.append(mix(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            found.append(words[:0])
    return found


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, bands, bits): set size, identity of the set, one value per collection, parity bitmap.

    A bit of the bitmap is the parity of the elements that fall on it, so two
    sets differ in at least as many elements as their bitmaps in bits.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())),
         ("bits", pa.list_(pa.int64()))]
    )

    def rows_of(values: np.ndarray, width: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // width + 1, dtype=np.int32) * width), pa.array(values))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets in chunks(batches):
            sets = shingle_sets(buffer, offsets)
            least = np.zeros((len(sets), len(_MINHASH)), np.uint64)
            parity = np.zeros((len(sets), BITMAP), np.uint8)
            for i, s in enumerate(sets):
                parity[i] = np.bincount((mix(s ^ _PLACE[2]) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
                for at in range(0, len(s), 4096):
                    low = (s[at : at + 4096, None] * _MINHASH).min(axis=0)
                    least[i] = np.minimum(least[i], low) if at else low
            pairs = mix(least.reshape(-1, ROWS)[:, 0])
            for row in range(1, ROWS):
                pairs = mix(pairs * _PLACE[0] + least.reshape(-1, ROWS)[:, row])
            arrays = [
                part.column("doc_id").cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(as_long(np.asarray([s.sum(dtype=np.uint64) for s in sets], np.uint64))),
                pa.array(as_long(np.asarray([mix(s ^ _PLACE[1]).sum(dtype=np.uint64) for s in sets], np.uint64))),
                rows_of(as_long(pairs).reshape(-1), COLLECTIONS),
                rows_of(np.packbits(parity, axis=1).reshape(-1).view(np.int64), BITMAP // 64),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    texts = whole_text(docs).where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(sign, "doc_id long, n long, s1 long, s2 long, bands array<long>, bits array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, table, id, company, size): a row per class and table in which it meets another class."""
    bands = classes.select("id", F.posexplode("bands").alias("band", "value"))
    # Written first, so that the join below reads two plain shuffles and a hot value's rows can be split.
    shared = materialize(bands.groupBy("band", "value").count().where(F.col("count") > 1), "shared-bands")
    met = bands.join(shared, ["band", "value"]).groupBy("id").agg(
        F.sum("count").alias("company"), F.sort_array(F.collect_list(F.struct("band", "value"))).alias("met")
    )
    pairs = list(combinations(range(COLLECTIONS), 2))
    table = F.explode(F.array([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    by_band = met.select("id", "company", F.map_from_entries("met").alias("met"), table.alias("t"))
    left, right = F.col("met")[F.col("t.a")], F.col("met")[F.col("t.b")]
    rows = by_band.where(left.isNotNull() & right.isNotNull()).select(
        F.xxhash64("t.a", left, "t.b", right).alias("key"), (F.col("t.a") * COLLECTIONS + F.col("t.b")).alias("table"), "id", "company"
    )
    full = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    return rows.join(materialize(full, "full-buckets"), "key")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold more than one component, with the component and the bucket's hub."""
    rooted = buckets.join(roots, "id")
    rank = F.struct("company", (-F.col("id")).alias("minus"), "root")
    hubs = rooted.groupBy("key").agg(F.max(rank).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"))
    hubs = hubs.where(F.col("low") != F.col("high")).select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.root").alias("hub_root"))
    return materialize(rooted.join(materialize(hubs, "hubs"), "key"), "mixed-buckets")


def _next_pairs(mixed: DataFrame, classes: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(id, hub): for each class untried partners of other components, those most like it first.

    A bucket proposes its hub to the other components, the hub of the other
    components to its own, and, from the second round on and in buckets of at
    most `SMALL` classes, to each class its neighbours by id: a few proposals
    per row of a bucket. A class takes the one with the most proposals in the
    first round; later, of the `PROPOSALS` with most, the `PARTNERS` that agree
    with it in most collections.
    """
    rank = F.struct("company", (-F.col("id")).alias("minus"), "root")
    others = mixed.where(F.col("root") != F.col("hub_root"))
    second = others.groupBy("key").agg(F.max(rank).alias("hub")).select("key", (-F.col("hub.minus")).alias("hub"))
    own = mixed.where(F.col("root") == F.col("hub_root")).select("key", "id")
    proposed = others.select("id", "hub").unionByName(own.join(materialize(second, "hubs"), "key").select("id", "hub"))
    if tried is None:
        votes = proposed.groupBy("id", "hub").agg(F.count("*").alias("votes"))
        best = votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("hub")).alias("minus"))).alias("best"))
        pairs = best.select("id", (-F.col("best.minus")).alias("hub"))
    else:
        beside = Window.partitionBy("key").orderBy("id")
        place = [f(F.struct("id", "root"), n).over(beside) for n in range(1, NEIGHBOURS + 1) for f in (F.lag, F.lead)]
        near = mixed.where(F.col("size") <= SMALL).select("id", "root", F.array(*place).alias("to"))
        near = near.select("id", "root", F.explode("to").alias("to")).where(F.col("root") != F.col("to.root"))
        proposed = proposed.unionByName(near.select("id", F.col("to.id").alias("hub")))
        met = tried.union(tried.select("hub", "id").toDF("id", "hub"))
        votes = proposed.groupBy("id", "hub").agg(F.count("*").alias("votes")).join(met, ["id", "hub"], "left_anti")
        most = Window.partitionBy("id").orderBy(F.desc("votes"), "hub")
        some = votes.withColumn("place", F.row_number().over(most)).where(F.col("place") <= PROPOSALS).select("id", "hub")
        theirs = classes.select(F.col("id").alias("hub"), F.col("bands").alias("hub_bands"))
        equal = F.size(F.filter(F.zip_with("bands", "hub_bands", lambda a, b: a == b), lambda same: same))
        alike = some.join(classes.select("id", "bands"), "id").join(theirs, "hub").select("id", "hub", equal.alias("equal"))
        like = Window.partitionBy("id").orderBy(F.desc("equal"), "hub")
        pairs = alike.withColumn("place", F.row_number().over(like)).where(F.col("place") <= PARTNERS)
    return pairs.select(F.least("id", "hub").alias("id"), F.greatest("id", "hub").alias("hub")).distinct()


def _rest(mixed: DataFrame, classes: DataFrame, tried: DataFrame | None, similarity: int) -> DataFrame:
    """(id, hub): all untried pairs of a table that lie in two components and may be similar enough.

    A bucket is dealt into chunks of about `BLOCK` classes, and every two chunks
    meet in a group of their own, so no task holds a large bucket. Pairs of a
    group are made by distance in its sorted rows and never leave the task
    unless sizes and bitmaps allow the similarity.
    """
    group = ["key", "table", "x", "y"]
    wide = mixed.select("key", "table", "id", "root", "size").join(classes.select("id", "n", "bands", "bits"), "id")
    dealt = wide.withColumn("chunks", F.ceil(F.col("size") / BLOCK)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.withColumn("x", F.least("chunk", "with")).withColumn("y", F.greatest("chunk", "with"))
    met = met.select(*group, "chunk", "id", "root", "n", "bands", "bits").repartition(*group).sortWithinPartitions(*group)
    plain = [*group, "chunk", "id", "root", "n"]

    def compare(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.zeros(len(c["id"]), bool)
        for g in group:
            new[1:] |= c[g][1:] != c[g][:-1]
        number = np.cumsum(new)
        at = np.arange(len(number))
        for apart in count(1):
            at = at[at + apart < len(number)]
            at = at[number[at] == number[at + apart]]
            if not len(at):
                break
            for part in range(0, len(at), 1 << 16):
                i = at[part : part + (1 << 16)]
                j = i + apart
                few, many = np.minimum(c["n"][i], c["n"][j]), np.maximum(c["n"][i], c["n"][j])
                able = (c["root"][i] != c["root"][j]) & (100 * few >= similarity * many)
                able &= (c["x"][i] == c["y"][i]) | (c["chunk"][i] != c["chunk"][j])
                i, j = i[able], j[able]
                # Exact: of S elements in both sets together at most S (100 - similarity) / (100 + similarity) differ.
                differ = np.bitwise_count((c["bits"][i] ^ c["bits"][j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                able = differ * (100 + similarity) <= (c["n"][i] + c["n"][j]) * (100 - similarity)
                i, j = i[able], j[able]
                same = c["bands"][i] == c["bands"][j]
                first = same.argmax(axis=1)
                same[np.arange(len(i)), first] = False
                own = same.any(axis=1) & (first * COLLECTIONS + same.argmax(axis=1) == c["table"][i])
                a, b = c["id"][i[own]], c["id"][j[own]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["id", "hub"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {p: batch.column(p).to_numpy().astype(np.int64) for p in plain}
            for name in ("bands", "bits"):
                c[name] = batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            # The last group may go on in the next batch.
            last = np.logical_and.reduce([c[g] == c[g][-1] for g in group])
            cut = len(last) - int(last.sum())
            yield from compare({k: v[:cut] for k, v in c.items()})
            held = {k: v[cut:] for k, v in c.items()}
        if held is not None:
            yield from compare(held)

    found = met.mapInArrow(pairs, "id long, hub long")
    return found if tried is None else found.join(tried, ["id", "hub"], "left_anti")


def _only(ids: DataFrame) -> DataFrame:
    """Written ids for a semi join: broadcast up to `BROADCAST_IDS` of them, a shuffled side beyond."""
    ids = materialize(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, members): the sorted shingle hashes of the chosen documents, written once for all rounds."""

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets in chunks(batches):
            blobs = [s.tobytes() for s in shingle_sets(buffer, offsets)]
            yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(blobs, pa.binary())], names=["id", "members"])

    texts = whole_text(docs).select(F.col("doc_id").cast("long").alias("id"), "text").join(_only(ids), "id", "left_semi")
    return materialize(texts.mapInArrow(as_sets, "id long, members binary"), "shingle-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those (id, hub) pairs whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for mine, other in zip(batch.column("mine"), batch.column("other"), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (mine, other))
                small, large = (a, b) if len(a) < len(b) else (b, a)
                if 100 * len(small) < similarity * len(large):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["id", "hub"]).filter(pa.array(keep, pa.bool_()))

    asked = _only(pairs.select("id").union(pairs.select(F.col("hub").alias("id"))))
    sets = sets.join(asked, "id", "left_semi")
    mine = sets.withColumnRenamed("members", "mine")
    other = sets.select(F.col("id").alias("hub"), F.col("members").alias("other"))
    return pairs.join(mine, "id").join(other, "hub").select("id", "hub", "mine", "other").mapInArrow(compare, "id long, hub long")


def components(nodes: DataFrame, links: DataFrame, steps: int | None = None) -> DataFrame:
    """(id, root): the smallest id reachable from every node, by repeated minimum labels.

    With `steps` the labels are those after so many rounds: of one component,
    but not yet all of its smallest id unless it is a star.

    Each round takes the least label among a node's neighbours and then the
    label of that label, so a chain shortens by half. Labels are written every
    round, so a lost executor costs one round at most.
    """
    both = materialize(links.select("id", "hub").union(links.select("hub", "id")).toDF("id", "to").distinct(), "links")
    labels = materialize(
        both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("root")), "labels"
    )
    for step in count(1):
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("root").alias("low"))
        lower = labels.join(near, "id").select("id", F.least("root", "low").alias("root"), F.col("root").alias("old"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("top"))
        jumped = lower.join(up, "root", "left").select("id", F.coalesce(F.least("root", "top"), "root").alias("root"), "old")
        written = materialize(jumped, "labels")
        labels = written.select("id", "root")
        if step == steps or (steps is None and written.where(F.col("root") != F.col("old")).isEmpty()):
            break
    return nodes.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    signed = materialize(signatures(docs), "signatures")
    same = ["n", "s1", "s2"]
    filled = signed.where(F.col("n") > 0)
    classes = materialize(
        filled.groupBy(*same).agg(F.min(F.struct("doc_id", "bands", "bits")).alias("first")).select(
            *same, F.col("first.doc_id").alias("id"), F.col("first.bands").alias("bands"), F.col("first.bits").alias("bits")
        ),
        "classes",
    )
    buckets = materialize(_buckets(classes), "buckets")
    sets = shingle_table(docs, buckets.select("id"))
    nodes = classes.select("id")
    roots = materialize(nodes.select("id", F.col("id").alias("root")), "roots")
    tried = links = None
    for _ in range(rounds):
        buckets = _mixed(buckets.select("key", "table", "id", "company", "size"), roots)
        fresh = materialize(_next_pairs(buckets, classes, tried), "pairs")
        if fresh.isEmpty():
            break
        tried = fresh if tried is None else tried.union(fresh)
        found = materialize(_confirmed(fresh, sets, similarity), "confirmed")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        # Labels that are not final yet only propose a pair too many.
        roots = materialize(components(nodes, links, steps=1), "roots")
    if links is not None:
        roots = materialize(components(nodes, links), "roots")
    mixed = _mixed(buckets.select("key", "table", "id", "company", "size"), roots)
    rest = materialize(_rest(mixed, classes, tried, similarity), "pairs")
    found = materialize(_confirmed(rest, sets, similarity), "confirmed")
    # Roots are the nodes now: what the last links join are whole components.
    a, b = roots.toDF("id", "a"), roots.toDF("hub", "b")
    joined = found.join(a, "id").join(b, "hub").select(F.col("a").alias("id"), F.col("b").alias("hub"))
    top = components(roots.select(F.col("root").alias("id")).distinct(), joined).toDF("root", "top")
    roots = roots.join(materialize(top, "roots"), "root").select("id", F.col("top").alias("root"))
    member = classes.select(*same, "id").join(roots, "id").select(*same, "root")
    return signed.join(member, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "doc_id").alias("component_id"),
        (F.coalesce("root", "doc_id") == F.col("doc_id")).alias("kept"),
    )
