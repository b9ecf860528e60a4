from __future__ import annotations

import re

from clickward.llm.decontaminate import contaminated, without_leaks

ITEM = "the quick brown fox jumps over the lazy dog and runs away from seven hungry wolves"


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df):
    return {(r.doc_id, r.item_id): (r.first_word, r.n_equal) for r in df.collect()}


def test_exact_substituted_and_clean(spark, documents):
    words = ITEM.split()
    changed = [w if i % 6 else "zzz" for i, w in enumerate(words)]
    rows = [
        (1, None),
        (2, ""),
        (3, f"before it, {ITEM.upper()}! after"),
        (4, "a b " + " ".join(changed)),
        (5, " ".join(reversed(words))),
        (6, "the quick brown fox jumps over a fence"),
        (7, "x " * 100_000 + ITEM),
        (8, ITEM),
        (None, ITEM),
    ]
    bench = benchmark(spark, [(1, ITEM), (2, None), (3, "too short"), (4, ITEM), (None, ITEM)])
    got = found(contaminated(documents(rows), bench))
    assert {k[0] for k in got} == {3, 4, 7, 8} and {k[1] for k in got} == {1, 4}
    assert got[3, 1] == (2, len(words)) and got[4, 1] == (2, len(words) - 3) and got[7, 4][0] == 100_000
    assert got == found(contaminated(documents(rows), bench, broadcast_seeds=0))


def test_excerpts_shifts_and_short_items(spark, documents):
    long = [f"w{i}" for i in range(100)]
    inserted = [*long[:48], "new", *long[48:]]
    rows = [
        (1, "a b " + " ".join(long[20:55])),
        (2, " ".join(inserted)),
        (3, " ".join([*long[:48], *long[50:]])),
        (4, " ".join(long[:12])),
        (5, "yes four short words here no"),
        (6, "four short other words here"),
    ]
    got = found(contaminated(documents(rows), benchmark(spark, [(1, " ".join(long)), (2, "four short words here")])))
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 2)}
    assert got[1, 1] == (-18, 35) and got[2, 1][1] == 100 and got[3, 1][1] == 98 and got[5, 2] == (1, 4)


def test_empty_tables(spark, documents):
    assert contaminated(documents([]), benchmark(spark, [(1, ITEM)])).count() == 0
    assert contaminated(documents([(1, ITEM)]), benchmark(spark, [])).count() == 0


def test_whole_items_are_found(spark, sf_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")

    def norm(t):
        return " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "

    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    texts = [(r.doc_id, norm(r.text)) for r in sf_docs.collect()]
    want = {(d, i) for d, t in texts for i, x in items if x in t}
    assert set(found(contaminated(sf_docs, bench))) >= want
    kept = without_leaks(sf_docs, bench)
    assert kept.columns == sf_docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()}.isdisjoint({d for d, _ in want})
