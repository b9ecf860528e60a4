from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from clickward.llm.spelling import spelling_groups


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(df).collect())


@pytest.mark.parametrize("letters,lengths", [("ab", (6, 7)), ("aéÿ×", (6, 8)), ("xyz", (63, 66))])
def test_same_as_all_pairs(documents, letters, lengths):
    rng = random.Random(len(letters))
    stems = ["".join(rng.choices(letters, k=rng.randint(*lengths))) for _ in range(12)]
    words = list(stems)
    for _ in range(60):
        w = list(rng.choice(words))
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [rng.choice(letters)], [w[i], rng.choice(letters)], [w[i], w[i]]])
        words.append("".join(w))
    rows = [(i, " ".join(w for w in words for _ in range(rng.choice([0, 1, 1, 5, 9])))) for i in range(8)]
    rows += [(100, " ".join([stems[0]] * 150)), (101, " ".join([words[20]] * 900))]
    want = brute(rows)
    assert any(w[1] for w in want) and any(w[4] > 1 for w in want)
    assert got(documents(rows)) == want


def test_chains_and_ties(documents):
    def many(word, n):
        return " ".join([word] * n)

    text = " ".join([many("aaaaaa", 5), many("aaaaab", 25), many("aaaabb", 125), many("aaabbb", 625), many("aaaaac", 25)])
    rows = [(3, text), (4, "AAAAAA'aaaaaa 1aaaaaa1")]
    want = brute(rows)
    assert got(documents(rows)) == want
    found = {w[0]: w[1:3] for w in want}
    assert found["aaaaaa"] == (None, "aaaaaa") and found["aaaaab"] == ("aaaabb", "aaabbb")


def test_long_and_odd_texts(documents):
    long = "ab" * 4000
    edits = [long, long[:-1], long[1:], "b" + long, long[:5000] + "z" + long[5001:], "z" * 20000]
    text = " ".join(" ".join([w] * (60 if w == long else 6)) for w in edits)
    rows = [(1, text), (2, None), (3, ""), (4, "a b c"), (1, "grüßen GRÜßEN " * 5), (1, "grüßen GRÜßEN " * 5)]
    found = brute([r for r in rows if r[0] != 1]) + brute([rows[0]]) + brute(rows[4:])
    assert got(documents(rows)) == sorted(found)
    assert got(documents([])) == [] == got(documents([(1, None)]))


def test_edited_runs(documents):
    rows = [(i, f"alphabet{chr(97 + i % 26)}word gamma delta") for i in range(2000)]
    rows += [(i, "commonword") for i in range(3000, 30000)]
    want = brute(rows)
    assert any(len(w[0]) == 9 for w in want)
    assert got(documents(rows)) == want
