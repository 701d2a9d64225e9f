import corpus_pipeline as cp
from helpers import SF, awkward, documents

from codeloom.llm import decontaminate, ngram_join, quality_rules, secrets


def test_stages_take_effect(spark):
    docs, columns = documents(spark), documents(spark).columns
    for name, f in cp.STAGES[:-1]:
        new = f(spark, docs, SF)
        assert new.columns == columns, name
        docs = cp.stage(new, "test")
    assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert ngram_join.jaccard_join(docs, 5, 80).where("component_id <> doc_id").count() <= 1
    assert all(not secrets.base_spans(r.text) for r in docs.collect())
    assert all(not quality_rules.base_failed(len(r.text.split()), 0) for r in docs.collect())
    out = cp.run(spark, SF)
    assert set(columns) <= set(out.columns) and out.where("taken <= 0").count() == 0
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for _, f in cp.STAGES:
        f(spark, docs, SF).count()
