from wayline.streaming.incremental import append_features


def test_each_file_is_processed_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "News_5years_02_2017_03.txt").write_text("One two. Three.")
    (src / "blank.txt").write_text("  ")
    append_features(spark, str(src), out, ck).awaitTermination()
    (src / "News_5years_02_2018_01_DS_LV1.txt").write_text("Four five")
    append_features(spark, str(src), out, ck).awaitTermination()
    append_features(spark, str(src), out, ck).awaitTermination()
    rows = sorted((r["year"], r["model"], r["num_words"]) for r in spark.read.parquet(out).collect())
    assert rows == [("2017", None, 3), ("2018", "DS", 2)]
