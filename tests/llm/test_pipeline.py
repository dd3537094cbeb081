"""The pipeline as a whole, and its stages in a row."""

import corpus_pipeline
from phenoframe.llm.stages import stored
from phenoframe.llm.text import documents

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    raw = documents(spark, SMALL)
    docs, kept = raw, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SMALL), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema == raw.schema
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    long = {r.doc_id for r in raw.collect() if len(r.text.split()) >= 60}
    assert good & long <= kept[0]
    assert docs.where("not round_trip").count() == 0
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(kept[-1])
