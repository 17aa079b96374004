from pyspark.sql import functions as F

from shutterloom.streaming import cache as streaming

CACHE = "path string, file_size long, file_modified timestamp, phash long"


def test_cache_is_kept_up_to_date(spark, tmp_path, monkeypatch):
    """Changes of three batches, with a whole version after every second one; a path keeps its latest entry."""
    monkeypatch.setattr(streaming, "COMPACT", 2)
    source, cache = str(tmp_path / "items"), str(tmp_path / "cache")
    streaming.start(spark.createDataFrame([], CACHE), cache)
    items = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, file_size long").withColumn("file_modified", F.lit(None).cast("timestamp"))
    items.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(items.schema).parquet(source)
    run = lambda value: streaming.maintain(stream, cache, lambda missing: missing.withColumn("phash", F.lit(value).cast("long")), str(tmp_path / "checkpoint")).awaitTermination()
    shown = lambda n: {r.path: (r.file_size, r.phash) for r in streaming.version(spark, cache, n).collect()}
    run(7)
    items.filter("path = '/b'").unionByName(items.filter("path = '/a'").withColumn("file_size", F.lit(9).cast("long"))).coalesce(1).write.mode("append").parquet(source)
    run(8)
    assert spark.read.parquet(f"{cache}/changes/v=1").count() == 1
    items.filter("path = '/a'").coalesce(1).write.mode("append").parquet(source)
    run(9)
    assert shown(0) == {"/a": (1, 7), "/b": (2, 7)} and shown(1) == {"/a": (9, 8), "/b": (2, 7)} and shown(2) == {"/a": (1, 9), "/b": (2, 7)}
