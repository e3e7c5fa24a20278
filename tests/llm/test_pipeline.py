"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        n = docs.count()
        assert n > 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if name in ("language ID", "SimHash near-dedup", "substring dedup"):
            assert before is None or n <= before, name
        before = n
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
