from __future__ import annotations

import zlib

from clickward.llm.quality import FEATURES, good_documents, learn, scored, text_features

SF_DIR = "/root/testdata/sf0.001"


def test_features_of_any_text():
    for text in ("", " \n", "word", "!" * 100_000, "ä|b " * 5000):
        assert len(text_features(text)) == len(FEATURES)


def test_held_out_accuracy(spark):
    # The smallest folder has too few labels; this one has about 130 held out.
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 80
    assert sum(r.predicted == q for r, q in held) >= 0.97 * len(held)
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_held_out_labels_are_not_learnt(spark, sf_docs):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = labels.selectExpr(
        "doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality"
    )
    assert learn(sf_docs, labels) == learn(sf_docs, turned)


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (2, ""), (3, "some text"), (None, "x")])
    labels = spark.createDataFrame([(1, 1), (2, 7), (3, None), (3, 1), (9, 0), (None, 0)], "doc_id long, quality int")
    rows = scored(docs, labels).collect()
    assert len(rows) == 5 and all(r.score == 0.5 for r in rows)
    assert scored(documents([]), labels).count() == 0
    assert good_documents(docs, labels).columns == docs.columns
