"""The registered corpus queries and the pipeline as a whole."""

from __future__ import annotations

import corpus_pipeline
import pytest
from compare import compare, duck

from clickward.llm import queries as corpus

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    ok, note = compare(spark, duck(SF_DIR), SF_DIR, name, corpus.queries()[name], corpus.oracle_sql()[name])
    assert ok, note


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in corpus.queries()) == list(range(1, 14))
    assert list(corpus_pipeline.queries()) == ["pipeline"]


def test_pipeline_stages(spark, sf_docs):
    """Each stage keeps what its operator, run on the same input, keeps."""
    from clickward.llm.decontaminate import contaminated
    from clickward.llm.line_dedup import dedup_lines
    from clickward.llm.near_dedup import near_duplicates
    from clickward.llm.quality import scored

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, sf_docs, SF_DIR).cache()
    assert ids(good) == ids(scored(sf_docs, labels).where("predicted = 1"))
    lines = stages["line_dedup"](spark, good, SF_DIR).cache()
    want = {r.doc_id: r.kept_text for r in dedup_lines(good).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    single = stages["minhash_near_dedup"](spark, lines, SF_DIR).cache()
    assert ids(single) == ids(near_duplicates(lines).where("kept"))
    clean = stages["benchmark_decontamination"](spark, single, SF_DIR).cache()
    assert ids(clean) == ids(single) - ids(contaminated(single, bench))
    for df in (good, lines, single, clean):
        assert sorted(df.columns) == sorted(corpus_pipeline.COLUMNS)
    packed = stages["best_fit_packing"](spark, clean, SF_DIR)
    assert ids(packed) == ids(clean)
    assert ids(corpus_pipeline.run(spark, SF_DIR)) == ids(clean)
