from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from clickward.llm import spot_signatures as ops
from clickward.llm.spot_signatures import COMMON, compared, near_fingerprints


def signatures(text):
    words = re.findall(r"[^\x00-/:-@\[-`{-\x7F]+", text.lower())
    common = [w in COMMON for w in words]
    found = {hashlib.md5(w.encode()).hexdigest()[:8] for w in [w for w, c in zip(words, common) if not c][:8]}
    for i, w in enumerate(words):
        if common[i] or not any(common[max(0, i - 8) : i]):
            after = [v for v, c in zip(words[i + 1 : i + 9], common[i + 1 : i + 9]) if not c]
            found.add(hashlib.md5(" ".join([w, *after[:2]]).encode()).hexdigest()[:8])
    return found


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()))
    after = dict(zip(order, order[1:] + order[:1]))
    out = []
    for i, t in rows:
        next_text, k = after[i, t][1], len(t) // 4
        edited = t[: len(t) - k] + next_text[:k]
        a, b, c = signatures(t), signatures(edited), signatures(next_text)
        prints = ["".join(sorted(s)) for s in (a, b)]
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out)


def got(df):
    return sorted(
        (str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in compared(df).collect()
    )


def prose(rng, n):
    return " ".join(rng.choice([rng.choice(COMMON[:40]), f"w{rng.randrange(400)}", f"v{rng.randrange(40)}."]) for _ in range(n))


def test_same_as_plain_python(documents):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 3, 9, 40, 300]))) for i in range(40)]
    rows += [(50, " | ".join(f"Cell{i}" for i in range(90))), (51, "über É🎈 naïve — 中文 文本 the the the"), (52, "the of and")]
    assert got(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n\t.,!"), (4, "a\x00b"), (5, "word " * 30000), (5, "word"), (5, "word"), (5, "word"), (9, "the"), (None, "no id"), (None, "none")]
    assert got(documents(rows)) == brute(rows)
    assert got(documents([])) == []
    alone = got(documents([(7, "alone in the world of words")]))
    assert alone == brute([(7, "alone in the world of words")]) and alone[0][6] == 1.0


def test_order_in_slices(documents, tight):
    rng = random.Random(4)
    rows = [(rng.randrange(10**9), prose(rng, 12)) for _ in range(90)] + [(None, "x"), (5, "a b"), (5, "c d")]
    assert got(documents(rows)) == brute(rows)


def test_edits_stay_near_and_others_do_not(sf_docs):
    rows = compared(sf_docs).where("n_chars >= 200").collect()
    assert sum(r.near_edited > 0.4 for r in rows) > 0.95 * len(rows)
    assert sum(r.near_next < 0.1 for r in rows) > 0.95 * len(rows)


def test_near_pairs_are_all_found(documents):
    rng = random.Random(5)
    stems = [prose(rng, 120) for _ in range(8)]
    rows = []
    for i in range(160):
        words = rng.choice(stems).split()
        for _ in range(rng.choice([0, 1, 3, 8])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words[: rng.choice([120, 120, 100, 70])])))
    rows += [(200, None), (201, ""), (202, "one"), (203, "one"), (204, "one two"), (205, stems[0] * 40)]
    member, links = near_fingerprints(documents(rows))
    sets = {i: signatures(t or "") for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    assert {r.doc_id: r.class_id for r in member.collect()} == {i: first[frozenset(s)] for i, s in sets.items()}
    classes = sorted(set(first.values()))
    want = {(a, b): round(like(sets[a], sets[b]), 9) for a in classes for b in classes if a < b and sets[a] and like(sets[a], sets[b]) >= 0.75}
    assert {(r.class_id, r.other_id): round(r.likeness, 9) for r in links.collect()} == want and len(want) > 50
    member, links = near_fingerprints(documents([]))
    assert member.count() == 0 == links.count()


def test_length_parts(spark):
    """Sets that can reach the limit lie in the same part or in adjacent ones."""
    part = {r.n: r.p for r in spark.range(1, 3000).select(F.col("id").alias("n"), ops.length_part(F.col("id")).alias("p")).collect()}
    for n in part:
        most = n * 4 // 3
        assert most not in part or part[most] - part[n] in (0, 1)
    assert part[1] == 0 < part[2] < part[2999]
