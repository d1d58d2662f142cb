"""The pipeline's stages, each on its own input, and as a whole."""

import corpus_pipeline
from lodestone.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        assert out.columns == first.columns and {r.doc_id for r in out.select("doc_id").collect()} <= ids
        assert 0 < out.count() <= docs.count(), name
        ids, docs = {r.doc_id for r in out.select("doc_id").collect()}, out
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids


def test_planted_rows(spark):
    """Copies and a benchmark passage go; clean documents stay until the mixture."""
    b = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if not any(x in r.text for x in b)][:20]
    rows = [tuple(r) for r in clean]
    long = max(rows, key=lambda r: len(r[1].split()))
    near = long[1].split(" ")
    near[3] = "changed"
    rows += [(90001, long[1], *long[2:]), (90002, " ".join(near), *long[2:]), (90003, "Some words. " + b[0] + " And more.", "en", "s", 1), (90004, "123 456", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(stages["language_id"](spark, docs, SF)) == ids(docs) - {90004}
    assert {90001, 90002} & ids(stages["ngram_join"](spark, docs, SF)) == set()
    assert 90003 not in ids(stages["decontaminate"](spark, docs, SF)) and ids(stages["decontaminate"](spark, docs, SF)) >= {r[0] for r in clean}
    assert 90001 not in ids(stages["line_dedup"](spark, docs, SF)) or len(long[1].split("\n")) > 1
