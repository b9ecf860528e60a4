from __future__ import annotations

import random
import re

from clickward.llm.near_dedup import components, near_duplicates


def brute(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


def test_families_match_brute_force(documents):
    rng = random.Random(3)
    rows, at = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "two one"), (906, "a " * 9)], 0
    for family in range(12):
        base = [f"t{rng.randrange(400)}" for _ in range(120)]
        for _ in range(15):
            rows.append((at, edited(rng, base, rng.randrange(9))))
            at += 1
    assert got(near_duplicates(documents(rows))) == brute(rows)


def test_given_documents_match(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert got(near_duplicates(sf_docs)) == brute(rows)


def test_empty_and_repeated(documents):
    assert near_duplicates(documents([])).count() == 0
    text = "a b c d e f g"
    rows = near_duplicates(documents([(5, text), (5, text), (3, text.upper()), (None, text)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(3, 3, True), (5, 3, False), (5, 3, False)]


def test_chain_has_one_component(spark):
    nodes = spark.range(50).toDF("id")
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 45)], "id long, hub long")
    roots = {r.id: r.root for r in components(nodes, links).collect()}
    assert {roots[i] for i in range(31)} == {0} and roots[45] == 40 and roots[49] == 49


def test_similar_pairs_among_many_of_one_template(documents):
    """Pairwise similarity is about 0.70 on the template and 0.78 in each pair: only the pairs are linked."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(1200)]

    def changed(words, places):
        words = list(words)
        for p in places:
            words[p] = f"w{rng.random()}"
        return words

    rows = []
    for _ in range(60):
        places = rng.sample(range(2, 1198, 6), 38)
        base = changed(template, places[:8])
        rows += [" ".join(changed(base, places[8:23])), " ".join(changed(base, places[23:]))]
    rng.shuffle(rows)
    want = brute(list(enumerate(rows)))
    assert len({root for _, root, _ in want.values()}) == 60
    assert got(near_duplicates(documents(list(enumerate(rows))))) == want
