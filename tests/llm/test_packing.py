from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from clickward.llm.packing import OpenBins, WordEncoder, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    "Don't stop, it's 4.0!! ÉCOLE Ärger### naïve, été. İstanbul ΣΑΣ ΟΔΟΣ. x<|endoftext|>y 12ab,34 áb é. ½ ²",
    "日本語 テキスト, кот. Кот! a_b c-d  x　y \x85 b\x1cc K ſ <|startoftext|>",
]


def test_ids_are_the_tokenizers():
    mine, theirs = WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ODD:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == mine.encode(text) == np.asarray(ids, "<u4").tobytes()


def test_round_trip(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(10, None), (11, "word, " * 9000), (12, "a"), (12, "a"), (-5, "b")]
    theirs = Tokenizer.from_file(PATH)
    got = pack_documents(documents(rows), PATH).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    for doc_id, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
        for r in by_doc[doc_id]:
            part = np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32) == (r.piece * 4096, zlib.crc32(part))
        copies = sum(i == doc_id for i, _ in rows)
        assert sum(r.length for r in by_doc[doc_id]) == len(ids) * copies


def test_given_documents_fill_sequences(sf_docs):
    got = pack_documents(sf_docs, PATH).collect()
    used = len({r.sequence_id for r in got})
    assert used <= 1.05 * -(-sum(r.length for r in got) // 4096) + 1


def test_fullest_bin_closes_first():
    bins = OpenBins(capacity=10, most=2)
    assert [bins.place(n) for n in (7, 6, 8)] == [(0, 0), (1, 0), (2, 0)]
    # The bin with 2 free closed; the best fit for 3 is the one with exactly 3 free.
    assert bins.place(2) == (0, 7) and bins.place(4) == (1, 6) and bins.place(1) == (0, 9)


def test_empty(documents):
    assert pack_documents(documents([]), PATH).count() == 0
