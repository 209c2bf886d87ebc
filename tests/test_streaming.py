from plumbline.streaming.drift import stream_row_drift


def test_each_batch_is_compared_with_the_snapshot(spark, tmp_path):
    snapshot = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "x"), (9, "n")], "k int, v string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k int, v string").parquet(source)
    out = str(tmp_path / "out")
    stream_row_drift(stream, snapshot, ["k"], out, str(tmp_path / "state")).awaitTermination()
    got = {(r["k"], r["kind"], r["changed_fields"]) for r in spark.read.parquet(out).collect()}
    assert got == {(2, "Modified", "v"), (9, "Added", "")}
