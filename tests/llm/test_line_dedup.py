from __future__ import annotations

from clickward.llm.line_dedup import SPACES, LineRuns, dedup_lines, line_keys

LONG = "A line that is long enough to count"


def brute(rows, min_docs=3, min_length=20):
    lower = {i: i + 32 for i in range(65, 91)}
    holders = {}
    split = {i: (t or "").split("\n") for i, t in rows}
    for i, lines in split.items():
        for line in lines:
            key = line.strip(SPACES).translate(lower)
            if len(key) >= min_length:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, lines in split.items():
        kept = [
            x
            for x in lines
            if len(holders.get(x.strip(SPACES).translate(lower), ())) < min_docs
            or i == max(holders[x.strip(SPACES).translate(lower)])
        ]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def got(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()}


ROWS = [
    (1, None),
    (2, ""),
    (3, f"{LONG}\nown\n\t {LONG.upper()} \x0b"),
    (4, LONG),
    (9, f"{LONG}\n{LONG}\nlast"),
    (5, "short line\n" * 3),
    (6, "short line"),
    (7, "ÄÖÜ line that only differs in Umlaut case\nx"),
    (8, "äöü line that only differs in Umlaut case"),
    (10, "y" * 300_000 + "\n" + LONG),
    (-4, "\n\n" + LONG),
]


def test_rows_match_brute_force(documents):
    assert got(dedup_lines(documents(ROWS))) == brute(ROWS)


def test_order_of_batches_does_not_matter(documents):
    lines = line_keys(documents(ROWS))
    tables = []
    for order in (range(4), reversed(range(4))):
        store = LineRuns(fan=2)
        for n in order:
            store.add(lines.where(lines.doc_id % 4 == n))
        tables.append(sorted(map(tuple, store.common().collect())))
    assert tables[0] == tables[1] != []


def test_given_documents_match(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert got(dedup_lines(sf_docs)) == brute(rows)


def test_empty_and_repeated(documents):
    assert dedup_lines(documents([])).count() == 0
    twice = dedup_lines(documents([(1, LONG), (1, LONG), (2, LONG), (None, LONG)])).collect()
    assert len(twice) == 4 and all(r.n_dropped == 0 for r in twice)
