"""The pipeline's stages on the smallest tables, each against what its operator says."""

import corpus_pipeline
from loomtrace.llm import jaccard, toxicity
from tests.conftest import SMALL


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in scores.collect() if not r.predicted}
    second = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    groups = jaccard.jaccard_components(docs, 5, 80).collect()
    assert {r.doc_id for r in second.collect()} == {r.component_id for r in groups}
    assert second.columns == first.columns == docs.columns
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` <> 1024").count() <= 1
