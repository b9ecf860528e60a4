"""Vector codes: products of small codebooks, learnt by rounds that skip most distances.

A vector's components become integers and fall into 16 equal parts; every part
position has a codebook. Assignments follow Drake and Hamerly: besides the
entry a part is assigned to, the table of the rounds keeps its b next closest
entries with a lower bound on the distance to each, in order, and one outer
bound for all entries that are not listed. When the entries move, each bound
falls by the movement. A part whose distance to its own entry stays below the
first bound keeps it; otherwise only the listed entries whose bounds reach
that distance are measured, and all entries only if the outer bound reaches
it as well. Bounds are rounded towards zero and decide only where they leave
no doubt, whatever is left is settled by integer distances, ties to the lower
index. So results do not depend on b, which every task adapts to what its
rows needed.

One round is two passes over a written table: sums per entry, made in the
tasks and added by Spark, and new assignments. Only codebooks reach the driver.

Special cases: rows whose vector is null, empty, or holds a null or a number
that is not finite are left out, and so are vectors that are not as long as
the one of the first vec_id or whose length is no multiple of 16. With fewer
than 64 vectors the codebooks are smaller. Repeated rows count each; vec_ids
that tie start the codebooks in the order of their components, null vec_ids
come last. Null labels form one group. An empty table gives an empty result.
Components are bounded by what 64-bit distances can hold (`largest`), beyond
that the run stops with an error. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickward.session import SkewPolicy, materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Listed entries at the start; every task doubles or halves the number within these limits.
START, LEAST, MOST = 4, 2, 16
# A task lists more if this share of its parts had to measure all entries.
COSTLY = 0.05
SALTS = 32

STATE = "vec_id long, label int, x array<int>, ids binary, bounds binary"
Codebooks = np.ndarray  # (part, entry, component), integers


def largest(dim: int) -> int:
    """Largest size of an integer component, so that distances with an index appended fit 64 bits."""
    return int((2**62 // (4 * ENTRIES * max(1, dim))) ** 0.5)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & finite


def _seeds(kept: DataFrame) -> np.ndarray:
    """Integer components of the vectors that start the codebooks."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    rows = kept.select("vec_id", "vector").orderBy(*order).limit(ENTRIES).collect()
    rows = [r.vector for r in rows if len(r.vector) == len(rows[0].vector)]
    return np.floor(SCALE * np.array(rows, np.float64))


def _checked(values: np.ndarray, dim: int) -> np.ndarray:
    if values.size and np.abs(values).max() > largest(dim):
        raise ValueError(f"Vector components must lie within {largest(dim) / SCALE:g} for integer distances")
    return values.astype(np.int64)


def _in_parts(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), PARTS, -1)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - entries[None, :, i]) ** 2
    return out


def _to_listed(x: np.ndarray, entries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own list of entries."""
    return ((x[:, None, :] - entries[ids]) ** 2).sum(axis=2)


def _below(bound: np.ndarray) -> np.ndarray:
    """Half-precision numbers that never exceed the given ones."""
    bound = np.clip(bound, 0, 65504)
    half = bound.astype(np.float16)
    return np.where(half > bound, np.nextafter(half, np.float16(0)), half)


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Roots that are never too small (up) or never too large."""
    return np.sqrt(squares.astype(np.float64)) * (1 + (1e-12 if up else -1e-12))


def nearest(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From all distances: the entry, its squared distance, the b next entries with their bounds and the outer bound."""
    count = len(entries)
    coded = distances(x, entries) * ENTRIES + np.arange(count)
    if b + 2 < count:
        coded = np.partition(coded, b + 1, axis=1)[:, : b + 2]
    coded.sort(axis=1)
    ids, low = (coded % ENTRIES).astype(np.uint8), _roots(coded // ENTRIES, up=False)
    if ids.shape[1] < b + 2:
        # Fewer entries than the list is long: the last bounds are out of reach.
        short = b + 2 - ids.shape[1]
        ids = np.pad(ids, ((0, 0), (0, short)))
        low = np.pad(low, ((0, 0), (0, short)), constant_values=np.inf)
    return ids[:, : b + 1], coded[:, 0] // ENTRIES, _below(low[:, 1:])


class Reassignment:
    """Assignments after the entries moved, from the bounds of the round before."""

    def __init__(self, before: Codebooks, after: Codebooks):
        self.after = after
        moved = ((before - after) ** 2).sum(axis=2)
        self.moved = _roots(moved, up=True)
        self.furthest = self.moved.max(axis=1)
        self.measured = 0

    def part(self, p: int, x: np.ndarray, ids: np.ndarray, bounds: np.ndarray, b: int):
        """Entries, squared distances and bounds of one part position, now with b listed entries.

        Also which rows were certain, and how long a list the uncertain ones looked at.
        """
        entries = self.after[p]
        listed, width = ids[:, 1:], ids.shape[1] - 1
        own = _to_listed(x, entries, ids[:, :1])[:, 0]
        reach = _roots(own, up=True)
        low = bounds.astype(np.float64)
        low[:, :width] -= self.moved[p][listed]
        low[:, width] -= self.furthest[p]
        low *= 1 - 1e-12
        # A bound may not pass the ones after it: then it says the same for all entries further out.
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        depth = (low <= reach[:, None]).sum(axis=1)
        every, some = depth > width, (depth > 0) & (depth <= width)
        out_ids, out_low, out_own = ids.copy(), low, own.copy()
        self.measured += len(x) + int(depth[some].sum()) + len(entries) * int(every.sum())
        if some.any():
            rows = np.flatnonzero(some)
            reachable = np.arange(width) < depth[rows, None]
            found = _to_listed(x[rows], entries, listed[rows])
            coded = np.concatenate([own[rows, None], found], axis=1) * ENTRIES + ids[rows]
            # Entries out of reach keep their bound; the others are ordered by their exact distance.
            lower = np.concatenate([_roots(own[rows], up=False)[:, None], low[rows, :width]], axis=1)
            lower[:, 1:] = np.where(reachable, _roots(found, up=False), lower[:, 1:])
            coded[:, 1:] = np.where(reachable, coded[:, 1:], np.iinfo(np.int64).max)
            best = coded.argmin(axis=1)
            at = np.arange(len(rows))
            out_own[rows] = coded[at, best] // ENTRIES
            lower[at, best] = -1.0
            order = lower.argsort(axis=1, kind="stable")
            out_ids[rows] = np.take_along_axis(ids[rows], order, axis=1)
            ordered = np.take_along_axis(lower, order, axis=1)[:, 1:]
            out_low[rows, :width] = np.minimum(ordered, low[rows, width:])
        out_low = _below(out_low)
        if b < width:
            out_ids, out_low = out_ids[:, : b + 1], out_low[:, : b + 1]
        elif b > width:
            # No further entry is known: the list says the outer bound for repeats of its own entry.
            extra = b - width
            out_ids = np.concatenate([out_ids, np.repeat(out_ids[:, :1], extra, axis=1)], axis=1)
            out_low = np.concatenate([out_low, np.repeat(out_low[:, -1:], extra, axis=1)], axis=1)
        if every.any():
            rows = np.flatnonzero(every)
            out_ids[rows], out_own[rows], out_low[rows] = nearest(x[rows], entries, b)
        return out_ids, out_own, out_low, depth


def adapted(b: int, depths: np.ndarray, width: int) -> int:
    """The next length of the lists, from how far the uncertain parts had to look."""
    if not depths.size:
        return b
    if (depths > width).mean() > COSTLY:
        return min(MOST, 2 * b)
    if np.quantile(np.minimum(depths, width), 1 - COSTLY) <= b // 2:
        return max(LEAST, b // 2)
    return b


def _blobs(values: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    width = flat.shape[1] * flat.itemsize
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _state(batch: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.int32).ravel())
    )
    names = ["vec_id", "label", "x", "ids", "bounds"]
    head = [batch.column(batch.schema.get_field_index(n)) for n in names[:2]]
    return pa.RecordBatch.from_arrays([*head, lists, _blobs(ids), _blobs(bounds)], names)


def first_assignment(kept: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Integers, entries and bounds of every vector, from all distances."""
    dim = codebooks.shape[0] * codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _checked(np.floor(SCALE * _matrix(batch, "vector").astype(np.float64)), dim)
            found = [nearest(part, codebooks[p], START) for p, part in enumerate(_in_parts(x).swapaxes(0, 1))]
            yield _state(batch, x, np.stack([f[0] for f in found], 1), np.stack([f[2] for f in found], 1))

    return kept.mapInArrow(run, STATE)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(rows, integers by part, entries, bounds) of the rows of a batch whose lists are equally long."""
    sizes = np.array([len(v) for v in batch.column(3).to_pylist()])
    for size in np.unique(sizes):
        rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
        width = int(size) // PARTS
        ids = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, PARTS, width)
        low = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.float16).reshape(-1, PARTS, width)
        yield rows, _in_parts(_matrix(rows, "x").astype(np.int64)), ids, low


def reassigned(state: DataFrame, before: Codebooks, after: Codebooks) -> DataFrame:
    """The state after the entries moved; distances are measured only where the bounds leave a doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, b = Reassignment(before, after), START
        for batch in batches:
            for rows, x, ids, low in _unpacked(batch):
                found = [work.part(p, x[:, p], ids[:, p], low[:, p], b) for p in range(PARTS)]
                integers = x.reshape(len(x), -1)
                yield _state(rows, integers, np.stack([f[0] for f in found], 1), np.stack([f[2] for f in found], 1))
                b = adapted(b, np.concatenate([f[3] for f in found]), ids.shape[2] - 1)

    return state.mapInArrow(run, STATE)


def coded(state: DataFrame, before: Codebooks, after: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every vector after the last movement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Reassignment(before, after)
        for batch in batches:
            for rows, x, ids, low in _unpacked(batch):
                width = ids.shape[2] - 1
                found = [work.part(p, x[:, p], ids[:, p], low[:, p], width) for p in range(PARTS)]
                digits = np.stack([f[0][:, 0] for f in found], 1).tobytes().hex()
                codes = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
                error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(codes, pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    return state.mapInArrow(run, "vec_id long, label int, code string, error long")


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Per task one row for each entry in use: how many parts it has, and the sum of each component."""
    parts, count, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * count, d), np.int64)
        rows = np.zeros(parts * count, np.int64)
        for batch in batches:
            for _, x, ids, _ in _unpacked(batch):
                place = (np.arange(parts) * count + ids[:, :, 0]).ravel()
                np.add.at(total, place, x.reshape(-1, d))
                rows += np.bincount(place, minlength=parts * count)
        used = np.flatnonzero(rows)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * d), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows[used]), sums], ["place", "n", "sums"])

    return state.mapInArrow(run, "place long, n long, sums array<long>")


def moved(state: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Every entry becomes the floor of its parts' mean; unused ones stay."""
    each = _sums(state, codebooks.shape).select("place", "n", F.posexplode("sums").alias("i", "v"))
    added = each.groupBy("place", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = codebooks.copy()
    flat = out.reshape(-1, out.shape[2])
    for r in added.collect():  # as many rows as the codebooks have components
        flat[r.place, r.i] = int(r.v) // r.n
    return out


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add the errors' sum over equal labels, nulls together.

    The sums are broadcast if they were counted and are few; beyond that a
    label's sum is repeated over salts, so that no task gets all its rows.
    """
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    named = sums.withColumnRenamed("label", "sum_label")
    same = F.col("label").eqNullSafe(F.col("sum_label"))
    if sums.count() <= SkewPolicy.of(codes.sparkSession).broadcast_rows:
        return codes.join(F.broadcast(named), same, "left").drop("sum_label")
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    repeated = named.withColumn("sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(repeated, same & (F.col("salt") == F.col("sum_salt")), "left")
    return joined.drop("sum_label", "salt", "sum_salt")


def codebook_digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector."""
    kept = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col(vector).alias("vector"))
    kept = kept.where(usable(F.col("vector")))
    seeds = _seeds(kept)
    if not len(seeds):
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        return none.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(codebook_digest(seeds)))
    dim = seeds.shape[1]
    kept = kept.where(F.size("vector") == dim)
    entries = np.ascontiguousarray(_in_parts(_checked(seeds, dim)).swapaxes(0, 1))
    state = materialize(first_assignment(kept, entries), "vector-state")
    for done in range(1, ROUNDS + 1):
        before, entries = entries, moved(state, entries)
        if done < ROUNDS:
            state = materialize(reassigned(state, before, entries), "vector-state")
    codes = materialize(coded(state, before, entries), "vector-codes")
    return with_label_error(codes).withColumn("codebooks_sha256", F.lit(codebook_digest(entries)))
