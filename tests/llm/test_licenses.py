from __future__ import annotations

import re

from clickward.llm.licenses import TEMPLATES, license_spans, winnow

import numpy as np


def rows(df):
    return [(r.doc_id, r.license, r.span_start, r.span_end) for r in df.orderBy("doc_id", "span_start").collect()]


def test_every_template_finds_itself(documents):
    names = list(TEMPLATES)
    got = license_spans(documents([(i, f"é 1 {TEMPLATES[n]} 2") for i, n in enumerate(names)])).collect()
    assert {(names[r.doc_id], r.coverage) for r in got if r.license == names[r.doc_id]} == {(n, 1.0) for n in names}


def test_changed_words_and_two_places(documents):
    notice = "Licensed under CC BY-NC 4.0."
    mit = TEMPLATES["MIT"].replace("any person", "every person").replace("\n", "\n// ").replace("without restriction", "with no restriction at all")
    got = rows(license_spans(documents([(1, notice + " x " + notice), (2, "// " + mit), (3, None), (4, ""), (5, "licensed under of the")])))
    assert got[:2] == [(1, "CC-BY-NC-4.0", 0, 27), (1, "CC-BY-NC-4.0", 31, 58)]
    assert [g[:2] for g in got[2:]] == [(2, "MIT")] and got[2][2] == 3
    assert license_spans(documents([])).count() == 0


def test_given_documents(sf_docs):
    notices = r"Licensed under CC BY-NC 4\.0|This work is licensed under the GNU General Public License, version 3|Licensed under the Apache License, Version 2\.0|Released under the MIT License|All rights reserved"
    want = {(r.doc_id, m.start(), m.end()) for r in sf_docs.collect() for m in re.finditer(notices, r.text or "")}
    assert {(d, a, b) for d, _, a, b in rows(license_spans(sf_docs))} == want != set()


def test_short_notice_of_all_rights(documents, sf_docs):
    long = TEMPLATES["All-rights-reserved"]
    got = rows(license_spans(documents([(1, "é (c) Me. ALL RIGHTS\nRESERVED."), (2, long), (3, "all rights are reserved")])))
    assert got == [(1, "All-rights-reserved-notice", 10, 29), (2, "All-rights-reserved", 0, len(long) - 1)]
    want = {(r.doc_id, m.start(), m.end()) for r in sf_docs.collect() for m in re.finditer("All rights reserved", r.text or "")}
    assert {(d, a, b) for d, n, a, b in rows(license_spans(sf_docs)) if n == "All-rights-reserved-notice"} == want


def test_winnow_keeps_one_in_every_window():
    values = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    kept = set(winnow(values, 4))
    assert all(kept & set(range(i, i + 4)) for i in range(197)) and len(kept) < 120


def test_no_other_license_is_named(documents):
    texts = [
        "Released under the BSD License.",
        "Released under the Apache License.",
        "Released under the GNU GPL v2.",
        "Licensed under the GNU General Public License",
        "This work is licensed under the terms of our shop, version 3.",
    ]
    got = rows(license_spans(documents(list(enumerate(texts)))))
    assert got == [(0, "BSD-named", 0, 30)]


def test_words_put_into_a_template(documents):
    mit = TEMPLATES["MIT"].split()
    long = " ".join(mit[:40] + [f"inserted{i}" for i in range(12)] + mit[40:])
    twice = TEMPLATES["MIT"] + " and " + TEMPLATES["MIT"]
    got = license_spans(documents([(1, long), (2, twice), (3, " ".join(mit[:30]))])).collect()
    assert sorted((r.doc_id, r.license, r.span_start, r.span_end) for r in got if r.license == "MIT") == [
        (1, "MIT", 0, len(long) - 1),
        (2, "MIT", 0, len(TEMPLATES["MIT"]) - 1),
        (2, "MIT", len(TEMPLATES["MIT"]) + 5, len(twice) - 1),
    ]
    assert not [r for r in got if r.doc_id == 3]


def best_alignment(template, text):
    """All cells, without a band: the most matched words of a local alignment of the best score."""
    score = np.zeros((len(template) + 1, len(text) + 1))
    matches = np.zeros_like(score)
    for i, a in enumerate(template, 1):
        for j, b in enumerate(text, 1):
            hit = a == b
            options = [(score[i - 1, j - 1] + (1 if hit else -0.5), matches[i - 1, j - 1] + hit)]
            options += [(score[i - 1, j] - 0.5, matches[i - 1, j]), (score[i, j - 1] - 0.5, matches[i, j - 1]), (0, 0)]
            score[i, j], matches[i, j] = max(options)
    return int(max(zip(score.ravel(), matches.ravel()))[1])


def test_coverage_is_that_of_an_alignment_without_a_band(documents):
    rng = np.random.default_rng(2)
    for name in ("MIT", "ISC", "Apache-2.0", "GPL"):
        template = re.findall("[a-z0-9]+", TEMPLATES[name].lower())
        changed = list(template)
        for _ in range(len(template) // 9):
            i = int(rng.integers(len(changed)))
            changed[i : i + 1] = [["word"], [], [changed[i], "more"]][int(rng.integers(3))]
        found = license_spans(documents([(1, "some words before " + " ".join(changed) + " and after")])).collect()
        assert [r.n_matched for r in found if r.license == name] == [best_alignment(template, changed)]
