from __future__ import annotations

import random
import re

from clickward.llm.suffix_dedup import shared_strings_removed


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        cover = bytearray(len(b))
        for k, s in enumerate(own):
            if s in seen:
                cover[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), kept)
    return out


def got(df):
    return {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in df.collect()}


def test_overlapping_pieces(documents):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 400))) for _ in range(30)]

    def text():
        out = ""
        for _ in range(3):
            a = rng.randint(0, 150)
            out += base[rng.randrange(30)][a : a + rng.randint(0, 300)]
        return out

    rows = [(i - 20, text() if i % 17 else None) for i in range(120)]
    rows += [(500, "é" * 300), (501, "xé" * 150 + "é" * 90), (502, "a" * 1000), (503, "a" * 49), (504, "a" * 50), (505, "ba" * 30)]
    assert got(shared_strings_removed(documents(rows), 2000)) == brute(rows)


def test_given_documents(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert got(shared_strings_removed(sf_docs, 100_000)) == brute(rows)


def test_edges(documents):
    long = "".join(chr(97 + i % 7 * (i % 11) % 26) for i in range(2_000_000))
    rows = [(1, long), (2, long[1_000_000:1_000_200]), (3, None), (4, "")]
    result = got(shared_strings_removed(documents(rows)))
    assert result[2] == (200, 200, 1, b"") and result[1][1] == 0 and result[3] == (0, 0, 0, b"")
    assert shared_strings_removed(documents([])).count() == 0
    twice = shared_strings_removed(documents([(7, long[:500]), (7, long[:500]), (None, long[:500])])).collect()
    assert [r.n_removed for r in twice] == [0, 0]
