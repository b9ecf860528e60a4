"""Histogram trees: boosting by leaves and forests, many models in the same passes over the rows.

Numbers are binned once, by quantiles, into a written table of one byte per
feature, in blocks of rows held by columns. A pass adds up, for every model and
every open node, sums per feature and bin inside the tasks; the sums meet by
model and node, and the tasks that get them look for the best split. Only
splits reach the driver, which holds the trees. Sums are whole numbers, and
samples of rows are drawn from a hash of the row id, so a fit is the same on
every partitioning.

There is about one task per core, as every task sends its own sums. The blocks
are read from memory or disk of the executors; what an executor loses is read
again from the written table.

Boosting has a shorter way where it can: a model that one task can hold, or one
of so many that each has a core anyway, grows all its trees in a task of its own
(`Alone`), without a pass of jobs per level. Both ways find the same trees.
Both count only the smaller of two siblings, the other is its parent's rest.

Trees grow by the leaf of the largest gain. A pass opens, besides the leaves
that are due, the leaves that would be next by what is known so far. What was
opened too early is cut off again: a tree is the one that a search leaf by
leaf finds, in about as many passes as it is deep.
"""

from __future__ import annotations

import heapq
import math
import mmap
import operator
import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickward.session import delete_scratch, scratch_path

BINS = 64
# Quantiles come from a sample of about so many rows, drawn by the hash of the row id.
EDGE_ROWS = 50_000
# Gradients become whole numbers of this fraction, so that their sums do not depend on the order.
SCALE = 2**20
# Sums that one pass of a forest may hold in a task, and nodes whose sums travel together.
PASS_BYTES = 64 << 20
NODE_BLOCK = 32
# Rows of the binned table in one block, and the most blocks of one task. A table of one task needs no shuffle in its passes.
TASK_ROWS = 50_000
TASK_BLOCKS = 64
# Up to so many rows a boosted model grows in a task of its own. With few cores for each model it does so up to the second number.
ALONE_ROWS = 1_000_000
ALONE_MOST = 1 << 26
# Rows that a model alone gets at once, and bytes of rows above which its task keeps them in a file of its own.
ALONE_BLOCK = 10_000
HELD_BYTES = 96 << 20
# Trees whose sums one process may hold: leaves, or levels.
MOST_LEAVES, MOST_DEPTH = 256, 8
# Boosting rounds after which the rows are written with their margins. Between, a round adds its trees to the margins of the one before.
REFRESH = 20


class Nodes(NamedTuple):
    """A tree as arrays; `feature` is -1 in a leaf, rows with bins up to `bin` go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def leaves_of(bins: np.ndarray, tree: Nodes) -> np.ndarray:
    """The node at which every row ends."""
    return _walked(np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1], 1, tree)


def _walked(flat: np.ndarray, start: np.ndarray, step: int, tree: Nodes) -> np.ndarray:
    """The node at which every row ends; its bin of feature f lies at its start plus f steps."""
    inner = tree.feature >= 0
    own = np.arange(len(inner))
    feature = np.where(inner, tree.feature, 0).astype(np.intp) * step
    # A leaf leads to itself.
    children = np.stack([np.where(inner, tree.left, own), np.where(inner, tree.right, own)], 1).astype(np.intp).ravel()
    out = np.zeros(len(start), np.intp)
    rows, node = np.arange(len(start)), out
    while True:
        going = inner.take(node)
        left = np.count_nonzero(going)
        if left < 0.75 * len(rows) or not left:
            out[rows] = node
            if not left:
                return out
            rows, node, start = rows[going], node[going], start[going]
        right = flat.take(start + feature.take(node)) > tree.bin.take(node)
        node = children.take(2 * node + right)



def _mixed(h: np.ndarray, *salt: int) -> np.ndarray:
    x = h.astype(np.uint64)
    for s in salt:
        x = x + np.uint64((s * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


def uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """A number from 0 to 1 for every row hash."""
    return (_mixed(h, *salt) >> np.uint64(11)) / float(2**53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap(h: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is in a bootstrap of its frame: Poisson of mean 1."""
    return np.searchsorted(_POISSON, uniform(h, seed))


@dataclass(frozen=True)
class Growth:
    """How trees grow; zero means without a bound."""

    leaves: int = 0
    depth: int = 0
    min_rows: int = 1
    min_hessian: float = 0.0
    ridge: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    node_columns: int = 0


class Split(NamedTuple):
    """The best split of a node, if it has one, and the sums of its rows and of the left ones."""

    gain: float
    feature: int
    bin: int
    total: tuple[int, ...]
    left: tuple[int, ...]


class Growing:
    """One tree on the driver, and which of its nodes have to be searched next."""

    def __init__(self, growth: Growth, rows_of: Callable[[Sequence[int]], int]):
        self.growth, self.rows_of = growth, rows_of
        self.splits: dict[int, Split] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.depth, self.sums = [0], [None]
        self.leaves, self.inner = {0}, set()
        self.open = [0]

    def _opened(self, node: int) -> tuple[int, int]:
        if node not in self.children:
            s = self.splits[node]
            right = tuple(t - l for t, l in zip(s.total, s.left))
            for sums in (s.left, right):
                self.depth.append(self.depth[node] + 1)
                self.sums.append(sums)
            pair = len(self.sums) - 2, len(self.sums) - 1
            self.children[node] = pair
            for child in pair:
                # Too deep or too few rows: known to be a leaf without a search.
                deep = self.growth.depth and self.depth[child] >= self.growth.depth
                if deep or self.rows_of(self.sums[child]) < 2 * self.growth.min_rows:
                    self.splits[child] = Split(0.0, -1, 0, self.sums[child], self.sums[child])
        return self.children[node]

    def absorb(self, found: dict[int, Split]) -> None:
        """Take the splits of the open nodes, grow as far as they allow, and say what is open next."""
        for node in self.open:
            self.splits[node] = found[node]
            self.sums[node] = found[node].total
        limit = self.growth.leaves or math.inf

        def grow(leaves: set[int], beyond_unknown: bool) -> list[int]:
            """Split the leaves by falling gain. An unknown leaf stops this, unless we only want to guess."""
            done = []
            heap = [(-self.splits[n].gain, n) for n in leaves if n in self.splits and self.splits[n].feature >= 0]
            heapq.heapify(heap)
            unknown = sum(n not in self.splits for n in leaves)
            # Without a bound on the leaves every leaf is split in the end, whatever the order.
            while heap and len(leaves) < limit and (beyond_unknown or not unknown or limit == math.inf):
                node = heapq.heappop(heap)[1]
                pair = self._opened(node)
                leaves.remove(node)
                leaves.update(pair)
                done.append(node)
                for child in pair:
                    if child not in self.splits:
                        unknown += 1
                    elif self.splits[child].feature >= 0:
                        heapq.heappush(heap, (-self.splits[child].gain, child))
            return done

        self.inner.update(grow(self.leaves, beyond_unknown=False))
        self.open = []
        if len(self.leaves) < limit and any(n not in self.splits for n in self.leaves):
            guess = set(self.leaves)
            grow(guess, beyond_unknown=True)
            self.open = sorted(n for n in guess if n not in self.splits)

    def arrays(self, value: Callable[[Sequence[int]], float] | None = None) -> Nodes:
        """All opened nodes, or with `value` the grown tree with the values of its leaves."""
        inner = self.inner if value else set(self.children)
        order, place = [0], {0: 0}
        for node in order:
            if node in inner:
                for child in self.children[node]:
                    place[child] = len(order)
                    order.append(child)
        if value is None:
            order = list(range(len(self.sums)))
            place = {n: n for n in order}
        feature = np.array([self.splits[n].feature if n in inner else -1 for n in order], np.int32)
        at = np.array([self.splits[n].bin if n in inner else 0 for n in order], np.uint8)
        sides = [np.array([place[self.children[n][k]] if n in inner else 0 for n in order], np.int32) for k in (0, 1)]
        values = np.array([value(self.sums[n]) if value and n not in inner else 0.0 for n in order])
        return Nodes(feature, at, *sides, values)

    def gains(self) -> list[tuple[int, float]]:
        return [(self.splits[n].feature, self.splits[n].gain) for n in sorted(self.inner)]


class Search(NamedTuple):
    """The open nodes of one model in a pass: the slot of each node, and the features looked at in each slot."""

    tree: Nodes
    slots: np.ndarray
    features: np.ndarray


def _packed(channels: Sequence[np.ndarray]) -> list[tuple[int, np.ndarray, int]]:
    """Columns to add up: the last two as one number where both sums are sure to fit into it, and its lower bits."""
    *others, a, b = channels
    bits = max(1, int(b.sum()).bit_length())
    if min(a.min(initial=0), b.min(initial=0)) >= 0 and (int(a.sum()) + 1) << bits < 2**53:
        return [*((c, o, 0) for c, o in enumerate(others)), (len(others), a * float(1 << bits) + b, bits)]
    return [(c, o, 0) for c, o in enumerate(channels)]


def add_up(slot: np.ndarray, at: np.ndarray, bins: np.ndarray, channels: Sequence[np.ndarray], features: np.ndarray) -> np.ndarray:
    """Sums per slot, feature, bin and channel over the rows `at` of a block, whose slots and channels are given."""
    slots, width = features.shape
    out = np.empty((slots, width, BINS, len(channels)), np.int64)
    first, rows = slot * BINS, bins.shape[1]
    columns, shared = _packed(channels), bool((features == features[0]).all())
    flat = None if shared else bins.reshape(-1)
    for j in range(width):
        if shared:
            mine = bins[features[0, j]]
            mine = mine if len(at) == rows else mine.take(at)
        else:
            mine = flat.take((features[:, j] * rows).take(slot) + at)
        cell = first + mine
        for c, column, bits in columns:
            # Exact: below 2^53 within the rows of one block.
            sums = np.bincount(cell, weights=column, minlength=slots * BINS).astype(np.int64).reshape(slots, BINS)
            if bits:
                out[:, j, :, c + 1] = sums & ((1 << bits) - 1)
                sums = sums >> bits
            out[:, j, :, c] = sums
    return out


def best_splits(sums: np.ndarray, features: np.ndarray, gain: Callable) -> list[Split]:
    """The best split of every slot; ties go to the lower feature, then the lower bin."""
    upto = sums.cumsum(axis=2)
    total = upto[:, 0, -1, :]
    left = upto[:, :, :-1, :]
    value = gain(left, total[:, None, None, :] - left, total[:, None, None, :])
    flat = value.reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    out = []
    for i, b in enumerate(best):
        j, cut = divmod(int(b), BINS - 1)
        found = flat[i, b] > 1e-9
        out.append(
            Split(
                float(flat[i, b]) if found else 0.0,
                int(features[i, j]) if found else -1,
                cut,
                tuple(total[i].tolist()),
                tuple(left[i, j, cut].tolist()) if found else tuple(total[i].tolist()),
            )
        )
    return out


def newton_gain(growth: Growth) -> Callable:
    """Channels: gradient, hessian, rows."""

    def score(s: np.ndarray) -> np.ndarray:
        return (s[..., 0] / SCALE) ** 2 / np.maximum(s[..., 1] / SCALE + growth.ridge, 1e-12)

    def gain(left: np.ndarray, right: np.ndarray, total: np.ndarray) -> np.ndarray:
        allowed = np.minimum(left[..., 2], right[..., 2]) >= max(1, growth.min_rows)
        allowed &= np.minimum(left[..., 1], right[..., 1]) >= growth.min_hessian * SCALE
        return np.where(allowed, score(left) + score(right) - score(total), -np.inf)

    return gain


def gini_gain(weights: tuple[float, float], growth: Growth) -> Callable:
    """Channels: rows of class 0 and of class 1, weighted by class."""

    def impurity(s: np.ndarray) -> np.ndarray:
        a, b = s[..., 0] * weights[0], s[..., 1] * weights[1]
        return 2 * a * b / np.maximum(a + b, 1e-12)

    def gain(left: np.ndarray, right: np.ndarray, total: np.ndarray) -> np.ndarray:
        allowed = np.minimum(left.sum(axis=-1), right.sum(axis=-1)) >= max(1, growth.min_rows)
        return np.where(allowed, impurity(total) - impurity(left) - impurity(right), -np.inf)

    return gain


class Tally:
    """A growing tree with the sums of its nodes, each over the same features."""

    def __init__(self, growth: Growth, columns: np.ndarray):
        self.growing, self.columns = Growing(growth, lambda s: s[2]), columns
        self.gain = newton_gain(growth)
        self.sums: dict[int, np.ndarray] = {}
        self.due = [0]

    def _pairs(self) -> list[tuple[int, int, int]]:
        """The parents of open nodes, with the child of fewer rows and the other one."""
        opened = set(self.growing.open)
        pairs = ((n, *pair) for n, pair in self.growing.children.items() if n in self.sums and opened.intersection(pair))
        rows = lambda n: self.growing.sums[n][2]
        return [(n, a, b) if rows(a) <= rows(b) else (n, b, a) for n, a, b in pairs]

    def take(self, counted: np.ndarray) -> None:
        """Take the sums of the nodes that were due, and say which are due next."""
        found = dict(zip(self.due, counted))
        for parent, small, large in self._pairs():
            found[large] = self.sums.pop(parent) - found[small]
        nodes = self.growing.open
        splits = best_splits(np.stack([found[n] for n in nodes]), np.tile(self.columns, (len(nodes), 1)), self.gain)
        self.sums.update((n, found[n]) for n, split in zip(nodes, splits) if split.feature >= 0)
        self.growing.absorb(dict(zip(nodes, splits)))
        self.due = [small for _, small, _ in self._pairs()]

    def search(self) -> Search:
        """The nodes that are due, for a pass over the rows."""
        slots = np.full(len(self.growing.sums), -1, np.int64)
        slots[self.due] = np.arange(len(self.due))
        return Search(self.growing.arrays(), slots, np.tile(self.columns, (len(self.due), 1)))


def _bounded(growth: Growth) -> bool:
    """Whether one process may hold the sums of all nodes of a tree."""
    return 0 < growth.leaves <= MOST_LEAVES or 0 < growth.depth <= MOST_DEPTH


@dataclass(frozen=True)
class Binning:
    """Features and the edges between their bins."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...] = field(repr=False)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Rows of numbers to rows of bins: how many edges lie below."""
        return np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(self.edges)], 1).astype(np.uint8)

    def values(self, df: DataFrame) -> Column:
        return F.array(*[_number(df, c) for c in self.features])


def _number(df: DataFrame, name: str) -> Column:
    """A feature without gaps: NULL, NaN and infinities are -1, texts are known by a checksum."""
    if dict(df.dtypes).get(name) == "string":
        return F.coalesce(F.crc32(name), F.lit(-1)).cast("double")
    value = F.col(name).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(-1.0))


def quantile_binning(df: DataFrame, features: Sequence[str], tie: str, rows: int) -> Binning:
    """Edges at equal shares of the sampled rows."""
    share = min(1.0, EDGE_ROWS / max(1, rows))
    drawn = F.pmod(F.xxhash64(F.lit("edges"), F.col(tie)), F.lit(2**30)) < F.lit(math.ceil(share * 2**30))
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = df.where(drawn).agg(*[F.percentile(_number(df, c), shares).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return Binning(tuple(features), tuple(np.unique(np.array(found[f"e{i}"] or [0.0])) for i in range(len(features))))


def _flat(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Rows(NamedTuple):
    """A block of the binned table by columns: bins by feature, weights and margins by model."""

    h: np.ndarray
    y: np.ndarray
    held_out: np.ndarray
    bins: np.ndarray
    weights: np.ndarray
    margins: np.ndarray

    def leaves(self, at: np.ndarray, tree: Nodes) -> np.ndarray:
        """The node at which each of the rows `at` ends."""
        return _walked(self.bins.reshape(-1), at, self.bins.shape[1], tree)


class Binned(NamedTuple):
    """The written table of the passes as blocks of rows, and its number of tasks."""

    blocks: RDD
    path: str
    tasks: int


def _written(spark: SparkSession, blocks: RDD, tasks: int) -> Binned:
    """Write blocks and read them back; the rows of one task stay in one task."""
    path = scratch_path(spark, "binned")
    # Spark puts ten batches into one record, which is several times in memory as it is written.
    blocks.saveAsPickleFile(path, 1)
    read = spark.sparkContext.pickleFile(path, 1).coalesce(tasks)
    return Binned(read.persist(StorageLevel.MEMORY_AND_DISK), path, tasks)


def _binned_blocks(
    df: DataFrame,
    binning: Binning,
    target: str,
    tie: str,
    weights: Sequence[Column],
    held_out: Column,
    margins: Sequence[float],
    full: int,
    tasks: int = 0,
) -> RDD:
    """Labelled rows with a weight in some model, and held-out rows, in blocks; with `tasks` as many parts of about one size."""
    chosen = df.where(F.col(target).isin(0, 1)).select(
        F.xxhash64(tie).alias("h"),
        F.col(target).cast("int").alias("y"),
        held_out.alias("held_out"),
        binning.values(df).alias("bins"),
        F.array(*[F.coalesce(w.cast("double"), F.lit(0.0)) for w in weights]).alias("weights"),
    )
    # Tasks capture numbers only: no columns and no frames.
    models = len(weights)

    def block(parts: list[Rows]) -> pa.RecordBatch:
        joined = Rows(*(np.ascontiguousarray(np.concatenate(c, axis=-1)) for c in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(joined, 5)], pa.binary())], ["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(
                Rows(
                    batch.column("h").to_numpy().view(np.uint64),
                    batch.column("y").to_numpy(),
                    batch.column("held_out").to_numpy(zero_copy_only=False),
                    binning.bins(_flat(batch, "bins", len(binning.features))).T,
                    _flat(batch, "weights", models).T,
                    np.repeat(np.array(margins, float)[:, None], batch.num_rows, axis=1),
                )
            )
            if sum(len(r.h) for r in held) >= full:
                yield block(held)
                held = []
        if held:
            yield block(held)

    used = chosen.where(F.col("held_out") | F.exists("weights", lambda w: w > 0))
    made = (used.repartition(tasks, "h") if tasks else used).mapInArrow(run, "block binary")
    return made.rdd.map(lambda r: pickle.loads(r[0]))


def binned_table(
    df: DataFrame,
    binning: Binning,
    target: str,
    tie: str,
    weights: Sequence[Column],
    held_out: Column,
    margins: Sequence[float],
    rows: int,
) -> Binned:
    """Labelled rows with a weight in some model, and held-out rows."""
    blocks = max(1, -(-rows // TASK_ROWS))
    tasks = max(min(blocks, df.sparkSession.sparkContext.defaultParallelism), -(-blocks // TASK_BLOCKS))
    made = _binned_blocks(df, binning, target, tie, weights, held_out, margins, TASK_ROWS, tasks)
    return _written(df.sparkSession, made, tasks)


# The rows of a block that a model uses, and the channels of those at given places among them.
Channels = Callable[[Rows, int], tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]]


def _summed(
    table: Binned, searches: dict[int, Search], channels: Channels, held_out_sum: Callable[[Rows, int], int] | None
) -> tuple[list[tuple[int, int]], RDD]:
    """One pass: the sums by model and block of nodes, and over held-out rows (block -1) where asked for."""
    keys = [(m, b) for m, s in searches.items() for b in range(0, len(s.features), NODE_BLOCK)]
    keys += [(m, -1) for m in searches] if held_out_sum is not None else []
    place = {key: i for i, key in enumerate(keys)}

    def partial(blocks: Iterator[Rows]) -> Iterator[tuple[int, np.ndarray]]:
        totals: dict[int, np.ndarray] = {}
        outside = dict.fromkeys(searches, 0)
        for rows in blocks:
            for m, search in searches.items():
                chosen, values = channels(rows, m)
                slot = search.slots[rows.leaves(chosen, search.tree)]
                inside = np.flatnonzero(slot >= 0)
                sums = add_up(slot[inside], chosen[inside], rows.bins, values(inside), search.features)
                if m in totals:
                    totals[m] += sums
                else:
                    totals[m] = sums
                if held_out_sum is not None:
                    outside[m] += held_out_sum(rows, m)
        for m, sums in totals.items():
            for b in range(0, len(sums), NODE_BLOCK):
                yield place[m, b], sums[b : b + NODE_BLOCK]
            if held_out_sum is not None:
                yield place[m, -1], np.array([outside[m]])

    met = table.blocks.mapPartitions(partial)
    return keys, met.reduceByKey(operator.add, min(len(keys), table.tasks)) if table.tasks > 1 else met


def search_sums(
    table: Binned, searches: dict[int, Search], channels: Channels, held_out_sum: Callable[[Rows, int], int] | None = None
) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """One pass: the sums of every node that is due, and over held-out rows where asked for."""
    keys, met = _summed(table, searches, channels, held_out_sum)
    found = {keys[k]: sums for k, sums in met.collect()}  # nodes of bounded trees
    empty = {m: np.zeros((*s.features.shape, BINS, 3), np.int64) for m, s in searches.items() if (m, 0) not in found}
    whole = {m: np.concatenate([found[k] for k in keys if k[0] == m and k[1] >= 0]) for m in searches if m not in empty}
    return empty | whole, {m: int(found[m, -1][0]) for m in searches if (m, -1) in found}


def search_splits(
    table: Binned,
    searches: dict[int, Search],
    channels: Channels,
    gains: Callable[[int], Callable],
    held_out_sum: Callable[[Rows, int], int] | None = None,
) -> tuple[dict[int, list[Split]], dict[int, int]]:
    """One pass: the best split of every open node of every model, and sums over held-out rows where asked for."""
    keys, summed = _summed(table, searches, channels, held_out_sum)

    def searched(met: tuple[int, np.ndarray]) -> tuple[int, int, list[Split] | int]:
        (m, block), sums = keys[met[0]], met[1]
        if block < 0:
            return m, block, int(sums[0])
        return m, block, best_splits(sums, searches[m].features[block : block + NODE_BLOCK], gains(m))

    splits: dict[int, list[Split]] = {m: [] for m in searches}
    outside = {}
    for m, block, found in sorted(summed.map(searched).collect(), key=lambda r: r[:2]):  # one split per open node
        if block < 0:
            outside[m] = found
        else:
            splits[m] += found
    return splits, outside


def _search(growing: Growing, columns: Callable[[int], np.ndarray]) -> Search:
    slots = np.full(len(growing.sums), -1, np.int64)
    slots[growing.open] = np.arange(len(growing.open))
    return Search(growing.arrays(), slots, np.stack([columns(n) for n in growing.open]))


def _absorb(growing: Growing, found: list[Split]) -> None:
    """A pass without any row of the model leaves no sums: the tree has only its root."""
    empty = Split(0.0, -1, 0, (0, 0, 0), (0, 0, 0))
    growing.absorb(dict(zip(growing.open, found or [empty] * len(growing.open))))


class Shelf:
    """Rows of one model in its task, by blocks. Many rows lie in a file without a name, of which one block is mapped at a time."""

    # Arrays of a block: type and bytes of a number, by name. Bins have one row per feature.
    KINDS = dict(margin=np.float64, h=np.uint64, weight=np.float64, node=np.int32, y=np.int8, held_out=np.bool_, inside=np.bool_)

    def __init__(self, rows: Iterable[tuple[np.ndarray, ...]], margin: float):
        self.margin, self.blocks, self.file, self.bytes = margin, [], None, 0
        waiting: list[tuple[np.ndarray, ...]] = []
        for part in rows:
            waiting.append(part)
            if sum(len(p[0]) for p in waiting) >= TASK_ROWS:
                self._add(waiting)
                waiting = []
        if waiting:
            self._add(waiting)
        if self.file:
            self.file.flush()

    def _add(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        h, y, held_out, weight, bins = (np.concatenate(c, axis=-1) for c in zip(*parts))
        buffer = np.zeros(self._size(len(h), len(bins)), np.uint8)
        block = self._arrays(buffer, len(h), len(bins))
        block["margin"][:] = self.margin
        for name, values in (("h", h), ("y", y), ("held_out", held_out), ("weight", weight), ("bins", bins)):
            block[name][:] = values
        self.blocks.append((len(h), len(bins), self.bytes, buffer))
        self.bytes += len(buffer)
        if self.bytes > HELD_BYTES:
            if self.file is None:
                # Where Spark spills to, if it says so.
                folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
                self.file = tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)] or None)
            for i, (*place, held) in enumerate(self.blocks):
                if held is not None:
                    self.file.write(held)
                    self.blocks[i] = (*place, None)

    def _arrays(self, buffer: np.ndarray, rows: int, width: int) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, kind in self.KINDS.items():
            end = at + rows * np.dtype(kind).itemsize
            out[name], at = buffer[at:end].view(kind), end
        out["bins"] = buffer[at : at + rows * width].reshape(width, rows)
        return out

    def __iter__(self) -> Iterator[dict[str, np.ndarray]]:
        for rows, width, at, buffer in self.blocks:
            if buffer is None:
                buffer = np.frombuffer(mmap.mmap(self.file.fileno(), self._size(rows, width), offset=at), np.uint8)
            yield self._arrays(buffer, rows, width)

    def _size(self, rows: int, width: int) -> int:
        """Bytes of a block, in whole pages, as only these can be mapped."""
        size = rows * (sum(np.dtype(k).itemsize for k in self.KINDS.values()) + width)
        return -(-size // mmap.ALLOCATIONGRANULARITY) * mmap.ALLOCATIONGRANULARITY


class Steps(NamedTuple):
    """The splits that rows have not gone through yet, as arrays by node, and what the nodes are worth."""

    new: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray | None = None


@dataclass(frozen=True)
class Alone:
    """Boosting of one model in one task: every row remembers its margin and its node."""

    growth: Growth
    seed: int
    rounds: int
    rate: float
    patience: int
    margin: float
    features: int

    def grow(self, rows: Iterable[tuple[np.ndarray, ...]]) -> tuple[list[Nodes], list, int]:
        """All trees, their gains, and up to which tree the loss on held-out rows fell."""
        shelf = Shelf(rows, self.margin)
        trees: list[Nodes] = []
        gains: list[list[tuple[int, float]]] = []
        best, last = (math.inf, 0), None

        def judged(loss: int) -> tuple[float, int]:
            return (loss, len(trees)) if self.patience and loss < best[0] else best

        for number in range(self.rounds):
            if self.patience and best[0] < math.inf and len(trees) - best[1] >= self.patience:
                break
            tally = Tally(self.growth, tree_columns(self.seed, number, self.growth, self.features))
            sums, loss = self._counted(shelf, tally, last, number)
            best, last = judged(loss), None
            tally.take(sums)
            gone: set[int] = set()
            while tally.growing.open:
                steps = _steps(tally.growing, gone)
                tally.take(self._counted(shelf, tally, steps)[0])
            if not tally.growing.inner:
                break
            leaf = newton_leaf(self.growth, self.rate)
            trees.append(tally.growing.arrays(leaf))
            gains.append(tally.growing.gains())
            last = _steps(tally.growing, gone)._replace(value=_worth(tally.growing, leaf))
        if self.patience:
            best = judged(sum(self._ended(block, last) for block in shelf))
        return trees, gains, best[1]

    def _ended(self, block: dict[str, np.ndarray], last: Steps | None) -> int:
        """Add the last tree to the margins; the loss on held-out rows."""
        if last is not None:
            _walk_on(block, last)
            block["margin"] += last.value.take(block["node"])
        if not self.patience:
            return 0
        return log_loss(block["margin"], block["y"], np.flatnonzero(block["held_out"]))

    def _counted(self, shelf: Shelf, tally: Tally, steps: Steps | None, number: int | None = None) -> tuple[np.ndarray, int]:
        """One pass, the first of a tree with its number: the sums of the nodes that are due, and the loss before the tree."""
        width, slots = len(tally.columns), np.full(len(tally.growing.sums), -1, np.intp)
        slots[tally.due] = np.arange(len(tally.due))
        out, loss = np.zeros((len(tally.due), width, BINS, 3), np.int64), 0
        # Rows to count, from as many blocks as it takes.
        bins, slot = np.empty((width, TASK_ROWS), np.uint8), np.empty(TASK_ROWS, np.intp)
        sums, filled = (np.empty(TASK_ROWS), np.empty(TASK_ROWS)), 0

        def flush() -> None:
            nonlocal out, filled
            if filled:
                channels = [*(c[:filled] for c in sums), np.ones(filled)]
                features = np.tile(np.arange(width), (len(tally.due), 1))
                out += add_up(slot[:filled], np.arange(filled), bins[:, :filled], channels, features)
            filled = 0

        for block in shelf:
            if number is not None:
                loss += self._ended(block, steps)
                block["node"][:] = 0
                block["inside"][:] = (block["weight"] > 0) & ~block["held_out"]
                if self.growth.row_share < 1:
                    block["inside"][:] &= uniform(block["h"], self.seed, number) < self.growth.row_share
            else:
                _walk_on(block, steps)
            mine = slots.take(block["node"])
            chosen = np.flatnonzero((mine >= 0) & block["inside"])
            while len(chosen):
                at, chosen = chosen[: TASK_ROWS - filled], chosen[TASK_ROWS - filled :]
                end = filled + len(at)
                for j, f in enumerate(tally.columns):
                    block["bins"][f].take(at, out=bins[j, filled:end], mode="clip")
                slot[filled:end] = mine.take(at)
                gradient, hessian = newton_sums(block["margin"].take(at), block["weight"].take(at), block["y"].take(at))
                sums[0][filled:end], sums[1][filled:end] = gradient, hessian
                filled = end
                if filled == TASK_ROWS:
                    flush()
        flush()
        return out, loss


def newton_sums(margin: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of rows, as whole numbers."""
    p = 1 / (1 + np.exp(-margin))
    w = weight * SCALE
    return np.rint(w * (p - y)), np.rint(w * p * (1 - p))


def newton_leaf(growth: Growth, rate: float) -> Callable[[Sequence[int]], float]:
    return lambda sums: -rate * (sums[0] / SCALE) / max(sums[1] / SCALE + growth.ridge, 1e-12)


def log_loss(margin: np.ndarray, y: np.ndarray, at: np.ndarray) -> int:
    """Loss of the rows `at`, in whole numbers."""
    z = margin[at]
    return int(np.rint(np.logaddexp(0, np.where(y[at] == 1, -z, z)) * SCALE).astype(np.int64).sum())


def tree_columns(seed: int, number: int, growth: Growth, features: int) -> np.ndarray:
    """The features of a tree."""
    width = max(1, math.ceil(growth.column_share * features))
    return np.sort(np.random.default_rng([seed, number]).permutation(features)[:width])


def _steps(growing: Growing, gone: set[int]) -> Steps:
    """The splits that were opened after those in `gone`, which takes them in."""
    tree, new = growing.arrays(), np.zeros(len(growing.sums), bool)
    new[[n for n in growing.children if n not in gone]] = True
    gone.update(growing.children)
    return Steps(new, tree.feature.astype(np.intp), tree.bin, tree.left, tree.right)


def _walk_on(block: dict[str, np.ndarray], steps: Steps) -> None:
    """Take rows through the new splits. The children of a new split have none yet."""
    node, bins = block["node"], block["bins"]
    rows = np.flatnonzero(steps.new.take(node))
    at = node.take(rows)
    right = bins.reshape(-1).take(steps.feature.take(at) * bins.shape[1] + rows) > steps.bin.take(at)
    node[rows] = np.where(right, steps.right.take(at), steps.left.take(at))


def _worth(growing: Growing, leaf: Callable[[Sequence[int]], float]) -> np.ndarray:
    """The value of every opened node: that of the leaf of the grown tree it lies in or below."""
    out, waiting = np.zeros(len(growing.sums)), [(0, None)]
    while waiting:
        node, value = waiting.pop()
        if value is None and node not in growing.inner:
            value = leaf(growing.sums[node])
        out[node] = 0.0 if value is None else value
        waiting += [(child, value) for child in growing.children.get(node, ())]
    return out


def _model_rows(rows: Rows, m: int) -> tuple[np.ndarray, ...]:
    """What one model needs of a block."""
    at = np.flatnonzero(rows.held_out | (rows.weights[m] > 0))
    return rows.h[at], rows.y[at], rows.held_out[at], rows.weights[m, at], rows.bins[:, at]


TREES = "model int, tree int, feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>"
SHARED = "features array<string>, edges array<array<double>>, margins array<double>, importances array<double>, rounds array<int>, kind string"


@dataclass(frozen=True)
class Ensemble:
    """Grown trees of one or more models over the same bins."""

    binning: Binning
    trees: tuple[tuple[Nodes, ...], ...] = field(repr=False)
    margins: tuple[float, ...] = ()
    importances: tuple[float, ...] = ()
    rounds: tuple[int, ...] = ()
    kind: str = "boosting"

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        """Mean over models of the probability of class 1."""
        out = np.zeros(len(bins))
        for m, trees in enumerate(self.trees):
            total = np.full(len(bins), self.margins[m])
            for tree in trees:
                total += tree.value[leaves_of(bins, tree)]
            out += 1 / (1 + np.exp(-total)) if self.kind == "boosting" else total / max(1, len(trees))
        return out / len(self.trees)

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        def score(values: pa.Array) -> pa.Array:
            flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.binning.features))
            return pa.array(self.probabilities(self.binning.bins(flat)))

        score.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return df.withColumn(out, F.arrow_udf(score, "double")(self.binning.values(df)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the trees, one row each, and what they share."""
        rows = [(m, t, *(a.tolist() for a in tree)) for m, trees in enumerate(self.trees) for t, tree in enumerate(trees)]
        spark.createDataFrame(rows, TREES).write.mode("overwrite").parquet(f"{path}/trees")
        edges = [e.tolist() for e in self.binning.edges]
        shared = [(list(self.binning.features), edges, *map(list, (self.margins, self.importances, self.rounds)), self.kind)]
        spark.createDataFrame(shared, SHARED).write.mode("overwrite").parquet(f"{path}/shared")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ensemble":
        s = spark.read.parquet(f"{path}/shared").first()
        binning = Binning(tuple(s["features"]), tuple(np.array(e) for e in s["edges"]))
        trees: list[list[Nodes]] = [[] for _ in s["margins"]]
        for r in spark.read.parquet(f"{path}/trees").orderBy("model", "tree").collect():  # a model fits the driver
            kinds = (np.int32, np.uint8, np.int32, np.int32, np.float64)
            trees[r["model"]].append(Nodes(*(np.array(v, k) for v, k in zip(r[2:], kinds))))
        return cls(binning, tuple(map(tuple, trees)), *(tuple(s[c]) for c in ("margins", "importances", "rounds")), s["kind"])


def _importances(width: int, grown: Sequence[list[tuple[int, float]]]) -> tuple[float, ...]:
    """Share of every feature in the gains, each tree counting the same."""
    out = np.zeros(width)
    for gains in grown:
        mine = np.zeros(width)
        for f, g in gains:
            mine[f] += g
        out += mine / mine.sum() if mine.sum() > 0 else 0
    return tuple((out / out.sum() if out.sum() > 0 else out).tolist())


def boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    tie: str,
    weights: Sequence[Column],
    seeds: Sequence[int],
    growth: Growth,
    rounds: int,
    rate: float,
    held_out: Column | None = None,
    patience: int = 0,
) -> Ensemble:
    """Logistic boosting of one model per weight column, all in the same passes.

    Every model starts at the log odds of its rows. With held-out rows a model stops when its loss on them
    has not fallen for `patience` rounds, and keeps the trees up to the lowest.
    """
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    weights = [F.when(held, F.lit(0.0)).otherwise(F.coalesce(w.cast("double"), F.lit(0.0))) for w in weights]
    rows = df.count()
    binning = quantile_binning(df.where(~held), features, tie, rows)
    odds = df.where(F.col(target).isin(0, 1)).agg(
        *[F.sum((F.round(w * SCALE)).cast("decimal(38,0)") * F.col(target)).alias(f"p{m}") for m, w in enumerate(weights)],
        *[F.sum((F.round(w * SCALE)).cast("decimal(38,0)")).alias(f"n{m}") for m, w in enumerate(weights)],
        F.count_if(held).alias("held"),
    ).first()
    patience = patience if odds["held"] else 0
    start = []
    for m in range(len(weights)):
        n = float(odds[f"n{m}"] or 0)
        share = min(max(float(odds[f"p{m}"] or 0) / n if n else 0.5, 1e-6), 1 - 1e-6)
        start.append(math.log(share / (1 - share)))
    models = range(len(weights))
    if _alone(df.sparkSession, rows, len(weights), growth):
        table = _binned_blocks(df, binning, target, tie, weights, held, start, ALONE_BLOCK)
        each = [Alone(growth, seeds[m], rounds, rate, patience, start[m], len(features)) for m in models]
        grown, gains, kept = _grown_alone(table, each)
    else:
        table = binned_table(df, binning, target, tie, weights, held, start, rows)
        grown, gains, kept = _grown_together(df.sparkSession, table, growth, seeds, rounds, rate, patience, len(features))
    last = kept if patience else [len(g) for g in grown]
    importances = _importances(len(features), [g for m in models for g in gains[m][: last[m]]])
    trees = tuple(tuple(grown[m][: last[m]]) for m in models)
    return Ensemble(binning, trees, tuple(start), importances, tuple(map(len, grown)))


def _alone(spark: SparkSession, rows: int, models: int, growth: Growth) -> bool:
    """Whether every model grows in a task of its own: few rows, or no more than two cores for each model."""
    crowded = rows <= ALONE_MOST and spark.sparkContext.defaultParallelism <= 2 * models
    return _bounded(growth) and (rows <= ALONE_ROWS or crowded)


Grown = tuple[list[list[Nodes]], list[list], list[int]]


def _grown_alone(blocks: RDD, each: Sequence[Alone]) -> Grown:
    """All models side by side, each in one task: trees, gains, and the tree up to which the loss fell."""

    def rows_of(rows: Rows) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        for m in range(len(each)):
            yield m, _model_rows(rows, m)

    def grow(m: int, rows: Iterator[tuple[int, tuple[np.ndarray, ...]]]) -> Iterator[tuple[int, tuple]]:
        yield m, each[m].grow(r for _, r in rows)

    found = blocks.flatMap(rows_of).partitionBy(len(each), int).mapPartitionsWithIndex(grow).collect()  # models fit the driver
    return tuple(map(list, zip(*(r for _, r in sorted(found, key=lambda r: r[0])))))


def _grown_together(
    spark: SparkSession,
    table: Binned,
    growth: Growth,
    seeds: Sequence[int],
    rounds: int,
    rate: float,
    patience: int,
    features: int,
) -> Grown:
    """All models in the same passes over the table, which is deleted in the end; results as of `_grown_alone`."""
    models = range(len(seeds))
    grown: list[list[Nodes]] = [[] for _ in models]
    gains: list[list] = [[] for _ in models]
    best = {m: (math.inf, 0) for m in models}
    active = list(models)

    def channels_of(number: int) -> Channels:
        def channels(rows: Rows, m: int) -> tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]:
            inside = (rows.weights[m] > 0) & ~rows.held_out
            if growth.row_share < 1:
                inside &= uniform(rows.h, seeds[m], number) < growth.row_share
            chosen = np.flatnonzero(inside)

            def values(places: np.ndarray) -> list[np.ndarray]:
                at = chosen[places]
                return [*newton_sums(rows.margins[m, at], rows.weights[m, at], rows.y[at]), np.ones(len(at))]

            return chosen, values

        return channels

    def loss(rows: Rows, m: int) -> int:
        return log_loss(rows.margins[m], rows.y, np.flatnonzero(rows.held_out))

    def judged(losses: dict[int, int]) -> None:
        for m, value in losses.items():
            if value < best[m][0]:
                best[m] = value, len(grown[m])

    def searched(growing: dict[int, Growing], columns: dict[int, np.ndarray], number: int, first: bool) -> dict[int, int]:
        searches = {m: _search(g, lambda n, c=columns[m]: c) for m, g in growing.items() if g.open}
        found, losses = search_splits(
            table, searches, channels_of(number), lambda m: newton_gain(growth), loss if first else None
        )
        for m in searches:
            _absorb(growing[m], found[m])
        return losses

    def counted(tallies: dict[int, Tally], number: int, first: bool) -> dict[int, int]:
        searches = {m: t.search() for m, t in tallies.items() if t.growing.open}
        sums, losses = search_sums(table, searches, channels_of(number), loss if first else None)
        for m in searches:
            tallies[m].take(sums[m])
        return losses

    older = None
    for number in range(rounds):
        if patience:
            active = [m for m in active if len(grown[m]) - best[m][1] < patience or best[m][0] == math.inf]
        if not active:
            break
        columns = {m: tree_columns(seeds[m], number, growth, features) for m in active}
        tallies = {m: Tally(growth, columns[m]) for m in active}
        growing = {m: t.growing for m, t in tallies.items()}
        first = patience > 0
        while any(g.open for g in growing.values()):
            # Sums of all nodes are kept here only where a tree is bounded.
            judged(counted(tallies, number, first) if _bounded(growth) else searched(growing, columns, number, first))
            first = False
        if older is not None:
            older.unpersist()
        newest = {}
        for m, g in growing.items():
            if not g.inner:
                active = [a for a in active if a != m]
                continue
            grown[m].append(g.arrays(newton_leaf(growth, rate)))
            gains[m].append(g.gains())
            newest[m] = grown[m][-1]
        older, table = table.blocks, _moved_on(spark, table, newest, (number + 1) % REFRESH == 0)
    if patience:
        # The last tree of a model was not judged yet.
        last = {m: _search(Growing(growth, lambda s: s[2]), lambda n: np.zeros(1, int)) for m in models}
        judged(search_splits(table, last, channels_of(0), lambda m: newton_gain(growth), loss)[1])
    _dropped(spark, table, older)
    return grown, gains, [best[m][1] for m in models]


def _moved_on(spark: SparkSession, table: Binned, newest: dict[int, Nodes], write: bool) -> Binned:
    """The table with the newest trees in its margins, written where asked for; then the one before is deleted."""

    def moved(rows: Rows) -> Rows:
        margins, every = rows.margins.copy(), np.arange(len(rows.h))
        for m, tree in newest.items():
            margins[m] += tree.value[rows.leaves(every, tree)]
        return rows._replace(margins=margins)

    blocks = table.blocks.map(moved)
    if not write:
        return table._replace(blocks=blocks.persist(StorageLevel.MEMORY_AND_DISK))
    out = _written(spark, blocks, table.tasks)
    delete_scratch(spark, table.path)
    return out


def _dropped(spark: SparkSession, table: Binned, *older: RDD | None) -> None:
    for blocks in (table.blocks, *older):
        if blocks is not None:
            blocks.unpersist()
    delete_scratch(spark, table.path)


def grown_forest(
    df: DataFrame, features: Sequence[str], target: str, tie: str, trees: int, growth: Growth, seed: int
) -> Ensemble:
    """A forest whose classes weigh the same inside every bootstrap.

    A bootstrap counts every row as often as a Poisson draw from its hash says. All trees grow in the same
    passes, level by level; a pass takes as many open nodes as its sums may use memory.
    """
    rows = df.count()
    binning = quantile_binning(df, features, tie, rows)
    table = binned_table(df, binning, target, tie, [F.lit(1.0)], F.lit(False), [0.0], rows)
    seeds = [seed * 1_000_003 + t for t in range(trees)]

    def channels(rows: Rows, t: int) -> tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]:
        times = bootstrap(rows.h, seeds[t])
        chosen = np.flatnonzero(times)

        def values(places: np.ndarray) -> list[np.ndarray]:
            at = chosen[places]
            n, y = times[at], rows.y[at]
            return [n * (1 - y), n * y]

        return chosen, values

    def counted(rows: Rows) -> np.ndarray:
        times = (bootstrap(rows.h, seeds[t]) for t in range(trees))
        return np.array([(n.sum(), (n * rows.y).sum()) for n in times])

    sizes = table.blocks.map(counted).fold(np.zeros((trees, 2), np.int64), operator.add)
    weight = {t: tuple(float(n) / (2.0 * max(1, c)) for c in (n - ones, ones)) for t, (n, ones) in enumerate(sizes.tolist())}

    width = min(len(features), growth.node_columns or max(1, int(math.sqrt(len(features)))))

    def columns(t: int) -> Callable[[int], np.ndarray]:
        return lambda n: np.sort(np.random.default_rng([seed, t, n]).permutation(len(features))[:width])

    growing = [Growing(growth, sum) for _ in range(trees)]
    per_pass = max(1, PASS_BYTES // (width * BINS * 2 * 8))
    while True:
        waiting = [t for t in range(trees) if growing[t].open]
        if not waiting:
            break
        while waiting:
            taken, nodes = [], 0
            while waiting and (not taken or nodes + len(growing[waiting[0]].open) <= per_pass):
                taken.append(waiting.pop(0))
                nodes += len(growing[taken[-1]].open)
            searches = {t: _search(growing[t], columns(t)) for t in taken}
            found, _ = search_splits(table, searches, channels, lambda t: gini_gain(weight[t], growth))
            for t in taken:
                _absorb(growing[t], found[t])

    def share(t: int) -> Callable[[Sequence[int]], float]:
        def value(sums: Sequence[int]) -> float:
            a, b = sums[0] * weight[t][0], sums[1] * weight[t][1]
            return b / (a + b) if a + b else 0.5

        return value

    _dropped(df.sparkSession, table)
    out = tuple(g.arrays(share(t)) for t, g in enumerate(growing))
    importances = _importances(len(features), [g.gains() for g in growing])
    return Ensemble(binning, (out,), (0.0,), importances, (trees,), kind="forest")
