from wellspring.streaming.features import read_plate_features, stream_plate_features


def test_restart_counts_each_file_once(spark, tmp_path):
    src, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    schema = "plate_id string, well_id string, label long, intensity double"
    spark.createDataFrame([("a", "A01", 1, 2.0), ("a", "A01", 2, None)], schema).write.parquet(src)
    stream_plate_features(spark, src, state, ck).awaitTermination(60)
    spark.createDataFrame([("a", "A01", 3, 4.0), ("b", "A02", 4, None)], schema).write.mode("append").parquet(src)
    stream_plate_features(spark, src, state, ck).awaitTermination(60)
    got = {(r.plate_id, r.well_id): (r.n, r.mean_intensity) for r in read_plate_features(spark, state).collect()}
    assert got == {("a", "A01"): (3, 3.0), ("b", "A02"): (1, None)}
