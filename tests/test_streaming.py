import shutil

from lathe.streaming import query


def test_stream_query(spark, tmp_path):
    """A file stream in the dialect gives the rows that the batch query gives."""
    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "a.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    counts = query(stream, "stream_events", "SELECT event_type, COUNT(*) AS n, SUM(value) / COUNT(*) AS mean FROM stream_events GROUP BY event_type", "ts")
    run = counts.writeStream.outputMode("complete").format("memory").queryName("stream_counts").start()
    try:
        run.processAllAvailable()
        got = {r["event_type"]: r["n"] for r in spark.sql("SELECT * FROM stream_counts").collect()}
    finally:
        run.stop()
    assert got == {r["event_type"]: r["count"] for r in batch.groupBy("event_type").count().collect()}
