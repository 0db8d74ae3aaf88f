import __spark_entry__
import corpus_pipeline
from cases import documents
from loanloom.llm import mixing, queries


def test_stages_return_document_columns_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.write_scratch(stage(spark, docs, sf), name.replace(" ", "-"))
        if i < 4:
            assert out.columns == docs.columns
        if i in (0, 1):
            assert 0 < out.count() < docs.count()
        if i == 2:
            assert out.count() == docs.count()
        if i == 3:
            goal = sum(r["size"] for r in docs.select(mixing.size_of().alias("size")).collect())
            assert abs(sum(r["size"] for r in out.select(mixing.size_of().alias("size")).collect()) - goal) < 0.02 * goal
        if i == 4:
            assert out.count() == docs.count() and out.filter("not intact or n_tokens <> size(ids)").count() == 0
        docs = out
    assert n > 0


def test_awkward_documents_pass_all_stages(spark, sf):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_scratch(stage(spark, docs if name != "substring dedup" else docs, sf), name.replace(" ", "-"))
    assert docs.filter("not intact").count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in queries.QUERIES) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
