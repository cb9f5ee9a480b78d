from folimetry.streaming.page_scores import read_scores, stream_run_means


def test_stream_gives_the_batch_means(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.6), (2, float("nan"))], "run long, score double")
    df.write.parquet(str(tmp_path / "in"))
    query = stream_run_means(read_scores(spark, str(tmp_path / "in"), df.schema), ["run"], "means", str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert {r.run: (round(r["mean"], 6), r.pages) for r in spark.table("means").collect()} == {1: (0.3, 2), 2: (0.6, 2)}
