from __future__ import annotations

import itertools
import re

import numpy as np

from clickward.llm.quality_rules import FLOOR, SPREAD, STATS, base_statistics, determinant_estimates, judged


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    grams, cover, seen, again = {}, set(), set(), 0
    for k in range(len(words) - 7):
        grams.setdefault(tuple(words[k : k + 8]), []).append(k)
    for places in grams.values():
        if len(places) > 1:
            for k in places:
                cover.update(range(k, k + 8))
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(cover))


ROWS = [
    (1, None),
    (2, ""),
    (3, "é#$ " * 40),
    (4, "one two three four five six seven eight " * 2),
    (5, "a\nb\na\n \n \n a\na"),
    (6, "x\x1cy\x85z " + "w " * 60_000),
    (7, " ".join(f"w{i}" for i in range(30))),
]


def stats(df):
    return {r.doc_id: tuple(r[s] for s in STATS) for r in df.collect()}


def test_base_statistics(documents, sf_docs):
    assert stats(base_statistics(documents(ROWS))) == {i: brute(t) for i, t in ROWS}
    assert stats(base_statistics(sf_docs)) == {r.doc_id: brute(r.text) for r in sf_docs.collect()}


def test_outliers_go_and_clean_texts_stay(documents):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["wordy", "words", "wording", "worded", "w"], rng.integers(40, 400)) + np.arange(1).astype(str))) for i in range(1)]
    rows = [(i, " ".join(f"{w}{k}" for k, w in enumerate(rng.choice(["word", "wo", "wording"], rng.integers(40, 400))))) for i in range(120)]
    rows += [(1000 + i, " ".join(w + "###" for w in t.split())) for i, t in rows[:9]]
    kept = {r.doc_id: r.kept for r in judged(documents(rows)).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[1000 + i] for i in range(9))


def test_estimate_ignores_a_far_quarter(spark):
    rng = np.random.default_rng(2)
    near, far = rng.normal(0, 1, (3000, 5)), rng.normal(30, 1, (700, 5))
    rows = [("a", "b", *map(float, r)) for r in np.concatenate([near, far])]
    df = spark.createDataFrame(rows, "g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = determinant_estimates(df, True).first()
    assert max(abs(got[f"c{i}"]) for i in range(5)) < 0.15
    assert 0.6 < got["p11"] < 1.4


def _least(x: np.ndarray) -> float:
    """Logarithm of the least determinant of all subsets of three quarters, by trying each."""
    size = int(np.ceil(0.75 * len(x)))
    floor = np.diag(np.square(FLOOR))
    tried = (x[list(c)] for c in itertools.combinations(range(len(x)), size))
    return min(np.linalg.slogdet(np.cov(t.T, bias=True) * SPREAD + floor)[1] for t in tried)


def test_determinants_against_all_subsets(spark):
    """Eight groups of 16 vectors with correlated numbers and three far ones each: near the least determinant of all subsets."""
    rows, want = [], {}
    for g in range(8):
        rng = np.random.default_rng(g)
        x = rng.normal(0, 2, (16, 5)) @ rng.normal(0, 1, (5, 5))
        x[:3] += rng.normal(0, 12, 5)
        want[str(g)] = _least(x)
        rows += [(str(g), "b", *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r.g_lang: r.logdet for r in determinant_estimates(df, True).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] >= want[g] - 1e-6 for g in want)
    assert sum(got[g] <= want[g] + 0.5 for g in want) >= 6, (got, want)


def test_estimate_is_where_steps_end(spark):
    """One more step from the result moves nothing, and equal vectors give the floor."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (400, 5)), rng.normal(9, 1, (80, 5))])
    rows = [("a", "b", *map(float, r)) for r in x] + [("same", "b", *[1.0] * 5)] * 60
    df = spark.createDataFrame(rows, "g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r.g_lang: r for r in determinant_estimates(df, True).collect()}
    e = got["a"]
    centre = np.asarray([e[f"c{i}"] for i in range(5)])
    precise = np.asarray([[e[f"p{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
    away = np.einsum("ij,jk,ik->i", x - centre, precise, x - centre)
    near = x[np.argsort(away)[:360]]
    again = np.linalg.slogdet(np.cov(near.T, bias=True) * SPREAD + np.diag(np.square(FLOOR)))[1]
    assert abs(again - e["logdet"]) < 0.02 and abs(near.mean(axis=0) - centre).max() < 0.02
    assert [got["same"][f"c{i}"] for i in range(5)] == [1.0] * 5
    assert abs(got["same"]["logdet"] - 2 * np.log(FLOOR).sum()) < 1e-9


def test_edges(spark, documents):
    got = {r.doc_id: (r.base_failed, r.kept) for r in judged(documents(ROWS)).collect()}
    assert got[1] == got[2] == (True, False) and got[3] == (True, False) and got[7] == (False, True)
    assert judged(documents([])).count() == 0
