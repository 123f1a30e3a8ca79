"""Streaming forms over files, run until all input is seen."""

from pyspark.sql import functions as F

from tidemark.streaming import events as S


def test_windows_match_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = tmp_path / "in"
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(source))
    stream = S.read(spark, str(source), batch.schema.simpleString()[7:-1].replace(":", " "))
    for name, frame in (("tumbling", S.tumbling(stream)), ("sessions", S.sessions(stream))):
        mode = "append" if name == "sessions" else "complete"
        query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").count().count()
    assert spark.table("tumbling").count() == want and spark.table("tumbling").agg(F.sum("n")).first()[0] == batch.count()
    assert 0 < spark.table("sessions").count() <= batch.groupBy("user_id", F.session_window("ts", "30 minutes")).count().count()


def test_changed_files_are_indexed_once(spark, tmp_path):
    source, seen = tmp_path / "files", []
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "path string, content string")
    rows.write.parquet(str(source))
    for k in range(2):
        stream = S.read(spark, str(source), "path string, content string")
        S.index_changed(stream, lambda b: seen.extend(r.path for r in b.collect()), str(tmp_path / "state")).awaitTermination(120)
        if k == 0:
            spark.createDataFrame([("a", "changed"), ("b", "y")], "path string, content string").write.mode("append").parquet(str(source))
    assert sorted(seen) == ["a", "a", "b"]
