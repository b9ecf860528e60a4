from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from clickward.llm import vector_codes as ops


def brute(rows):
    """The contract in plain Python: all distances in every round."""
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[2]))
    d = len(kept[0][2]) // 16
    parts = [[v[p * d : (p + 1) * d] for p in range(16)] for _, _, v in kept]
    books = [[parts[i][p] for i in range(min(64, len(kept)))] for p in range(16)]

    def assign():
        out = []
        for row in parts:
            dist = [[sum((a - b) ** 2 for a, b in zip(row[p], c)) for c in books[p]] for p in range(16)]
            out.append([(min(range(len(s)), key=lambda j: (s[j], j)), min(s)) for s in dist])
        return out

    for _ in range(2):
        found = assign()
        for p in range(16):
            for j in range(len(books[p])):
                mine = [parts[i][p] for i in range(len(kept)) if found[i][p][0] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    error = [sum(e for _, e in f) for f in found]
    by_label = {}
    for (_, label, _), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(
        (i, "".join(f"{c:02x}" for c, _ in f), e, by_label[label], digest) for (i, label, _), f, e in zip(kept, found, error)
    )


def frame(spark, rows):
    data = [(i, [float(x) if x is not None else None for x in v] if v is not None else None, label, 7, "x") for i, label, v in rows]
    schema = "vec_id long, embedding array<double>, label int, error int, code string"
    return spark.createDataFrame(data, schema).repartition(3)


def got(spark, rows):
    out = ops.compressed(frame(spark, rows)).collect()
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out)


@pytest.mark.parametrize("spread,d", [(0.3, 2), (3.0, 1), (0.01, 3)])
def test_same_as_all_distances(spark, spread, d):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, spread, (9, 16 * d))
    rows = [(i, i % 3 or None, (centres[i % 9] + rng.normal(0, spread / 3, 16 * d)).tolist()) for i in range(700)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 1, rng.normal(0, 1, 16).tolist()) for i in range(90)]
    rows += [rows[3], rows[3], (200, None, [0.0] * 16), (201, None, [-0.001] * 16)]
    odd = [(300, 1, None), (301, 1, []), (302, 1, [None] + [0.0] * 15), (303, 1, [math.nan] * 16), (304, 1, [math.inf] * 16), (305, 1, [-math.inf] * 16)]
    assert got(spark, rows + odd) == brute(rows)
    assert got(spark, rows + [(306, 1, [1.0] * 32), (307, 1, [1.0] * 17)]) == brute(rows)
    assert got(spark, rows[:3]) == brute(rows[:3])
    assert got(spark, odd) == [] == got(spark, [])


def test_too_large_for_integer_distances(spark):
    with pytest.raises(Exception, match="integer distances"):
        got(spark, [(1, 1, [1e30] * 16), (2, 1, [0.0] * 16)])


def test_label_sums_beyond_the_broadcast_limit(spark, tight):
    rng = np.random.default_rng(7)
    rows = [(i, i % 40 or None, rng.normal(0, 1, 16).tolist()) for i in range(200)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("b,next_b", [(1, 3), (4, 2), (2, 2)])
def test_bounds_hold_after_any_movement(b, next_b):
    """Every bound is at most the distance it stands for, whatever the lists were and are, and few distances are needed."""
    rng = np.random.default_rng(b)
    x = rng.integers(-400, 400, (600, 3))
    books = [rng.integers(-400, 400, (1, 20, 3))]
    ids, _, low = ops.nearest(x, books[0][0], b)
    for step in (3, 30, 300):
        books.append(books[-1] + rng.integers(-step, step, books[-1].shape))
        work = ops.Reassignment(books[-2], books[-1])
        ids, own, low, _ = work.part(0, x, ids, low, next_b)
        exact = ops.distances(x, books[-1][0])
        assert (ids[:, 0] == exact.argmin(axis=1)).all() and (own == exact.min(axis=1)).all()
        listed = np.take_along_axis(exact, ids[:, 1:].astype(int), axis=1)
        assert ids.shape[1] == next_b + 1 == low.shape[1]
        # A longer list repeats an entry; its least bound counts, and none is needed for the part's own entry.
        same = ids[:, 1:, None] == ids[:, None, 1:]
        least = np.where(same, low[:, None, :-1].astype(float), np.inf).min(axis=2)
        assert ((least <= np.sqrt(listed)) | (ids[:, 1:] == ids[:, :1])).all()
        outside = exact.copy()
        np.put_along_axis(outside, ids.astype(int), np.iinfo(np.int64).max, axis=1)
        assert (low[:, -1].astype(float) <= np.sqrt(outside.min(axis=1))).all()
        if step == 3:
            assert work.measured < 0.5 * exact.size


def test_list_lengths_adapt():
    assert ops.adapted(4, np.full(100, 5), 4) == 8
    assert ops.adapted(4, np.zeros(100, int), 4) == 2
    assert ops.adapted(4, np.array([0] * 50 + [3] * 50), 4) == 4
    assert ops.adapted(16, np.full(9, 17), 16) == 16
