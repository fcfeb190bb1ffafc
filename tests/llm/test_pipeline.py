import corpus_pipeline as cp
from ferngraph.llm import queries


def test_registry():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{k}" for k in range(1, 11)]
    assert "pipeline" in names and len(cp.STAGES) == 5


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= before
