import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        n.append(docs.count())
    assert n[1] <= n[0] and n[2] <= n[1] and n[3] <= n[2] and n[5] == n[4] > 0
