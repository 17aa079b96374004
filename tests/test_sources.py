import json
import struct

from pyspark.sql import functions as F

from shutterloom.plans import organise
from shutterloom.sources import catalogue, journal


def test_roots():
    assert catalogue.roots(["/a/b", "/a", "/a/", "/ab", "/a/b/c", "/ab/../a/./x"]) == ["/a", "/ab"]


def test_files_are_listed_without_content(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/keep.JPG").write_bytes(b"x" * 2000)
    files = catalogue.list_files(spark, str(tmp_path))
    assert [(r.path, r.file_size, r.source_root) for r in files.collect()] == [(str(tmp_path / "d/keep.JPG"), 2000, str(tmp_path))]
    assert catalogue.scan(files).first().file_name == "keep.JPG"


def test_scan_switches(spark):
    paths = {"/r/keep.JPG": 2000, "/r/.hidden.jpg": 2000, "/r/.dir/in.jpg": 2000, "/r/X.app/in.jpg": 2000, "/r/small.png": 10, "/r/note.txt": 2000, "/r/v.mp4": 2000}
    files = spark.createDataFrame([*paths.items(), ("/r/v.mp4", 2000)], "path string, file_size long").withColumn("source_root", F.lit("/r"))
    names = lambda **s: sorted(r.file_name for r in catalogue.scan(files, catalogue.ScanSettings(**s)).collect())
    assert names() == ["keep.JPG", "v.mp4"]
    assert names(skip_hidden=False) == [".hidden.jpg", "in.jpg", "keep.JPG", "v.mp4"]
    assert names(skip_packages=False) == ["in.jpg", "keep.JPG", "v.mp4"]
    assert len(names(skip_hidden=False, skip_packages=False)) == 5
    assert names(include_videos=False, minimum_bytes=1) == ["keep.JPG", "small.png"]
    out = spark.createDataFrame([("/r/X.app",)], "path string")
    assert catalogue.scan(files, catalogue.ScanSettings(skip_packages=False), out).filter("file_name = 'in.jpg'").count() == 0


def test_cache(spark):
    when = F.timestamp_seconds(F.col("m"))
    items = spark.createDataFrame([("/a", 1, 10.0, "e"), ("/b", 2, 10.0, None), ("/c", 3, 13.0, None), ("/d", 4, None, None)], "path string, file_size long, m double, error string").withColumn("file_modified", when).drop("m")
    cache = spark.createDataFrame([("/a", 1, 11.9, 5), ("/b", 9, 10.0, 6), ("/c", 3, 10.0, 7), ("/d", 4, 1.0, 8), ("/gone", 1, 1.0, 9)], "path string, file_size long, m double, phash long").withColumn("file_modified", when).drop("m")
    got = {r.path: (r.is_hit, r.phash, r.error) for r in catalogue.cache_lookup(items, cache).collect()}
    assert got == {"/a": (True, 5, None), "/b": (False, None, None), "/c": (False, None, None), "/d": (True, 8, None)}
    fresh = items.filter("path IN ('/b', '/c')").select("path", "file_size", F.lit(1).cast("long").alias("phash"), "file_modified")
    assert {r.path: r.phash for r in catalogue.cache_upsert(cache, fresh, items).collect()} == {"/a": 5, "/b": 1, "/c": 1, "/d": 8}


def test_container_times(spark, tmp_path):
    (tmp_path / "v0.mp4").write_bytes(b"\0" * 9 + b"mvhd\0\0\0\0" + struct.pack(">I", 2082844800 + 60) + b"\0" * 9)
    (tmp_path / "v1.mp4").write_bytes(b"\0" * 700_000 + b"mvhd\1\0\0\0" + struct.pack(">Q", 2082844800 + 90))
    (tmp_path / "no.mp4").write_bytes(b"mvhd\0\0\0\0" + struct.pack(">I", 7))
    got = {r.path.rsplit("/", 1)[1]: r.created_seconds for r in catalogue.container_times(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"v0.mp4": 60, "v1.mp4": 90, "no.mp4": None}


def test_journal_tolerates_bad_lines(spark, tmp_path):
    folder = tmp_path / "j" / "session_id=s1"
    folder.mkdir(parents=True)
    good = {"id": "1", "timestamp": "2024-01-01T00:00:00Z", "kind": "trash", "sourcePath": "/a", "result": "success", "fileSize": 5, "undone": True}
    (folder / "x.json").write_text(json.dumps(good) + "\nnot json\n" + json.dumps({"id": "2"}) + "\n")
    got = {r.id: (r.kind, r.result, r.fileSize, r.undone) for r in journal.read(spark, str(tmp_path / "j")).collect()}
    assert got == {"1": ("trash", "success", 5, True), "2": ("move", "failed", 0, False)}


def test_many_sessions_make_few_files(spark, tmp_path, monkeypatch):
    """A thousand sessions in four buckets; rewritten ones are replaced as a whole, others stay, bad lines too."""
    monkeypatch.setattr(journal, "BUCKETS", 4)
    path = str(tmp_path / "j")
    rows = spark.range(3000).select(F.nullif((F.col("id") % 1000).cast("string"), F.lit("7")).alias("session_id"), F.col("id").cast("string").alias("id"), F.lit("success").alias("result"), F.lit(False).alias("undone")).repartition(8)
    journal.append(rows, path)
    assert len(list((tmp_path / "j").glob("*/*.json"))) <= 16
    next((tmp_path / "j").glob("bucket=*")).joinpath("x.json").write_text('not json\n{"id": "z", "session_id": "new"}\n')
    changed = rows.filter("id < 1000 AND (session_id < '2' OR session_id IS NULL)").withColumn("undone", F.lit(True))
    journal.rewrite(changed, path)
    got = sorted((r.id, r.session_id or "7", r.undone) for r in journal.read(spark, path).collect())
    hit = lambda i: str(i % 1000) < "2" or i % 1000 == 7
    assert got == sorted([(str(i), str(i % 1000), hit(i)) for i in range(3000) if i < 1000 or not hit(i)] + [("z", "new", False)])
    assert "not json" in "".join(f.read_text() for f in (tmp_path / "j").glob("*/*") if f.is_file() and f.suffix != ".crc")


def test_exports(spark, tmp_path):
    ops = spark.createDataFrame([(1, True, "move", 'a "b", c.jpg', "/s", None, "r", 5)], "op_ordinal long, selected boolean, op_kind string, file_name string, source_path string, destination_path string, reason string, file_size long")
    journal.export_csv(ops, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["文件名"] == 'a "b", c.jpg'
    journal.export_json(ops, organise.transfer_summary(ops), spark.createDataFrame([("x", 1)], "code string, n long"), str(tmp_path / "json"))
    assert "destination_path" not in spark.read.json(str(tmp_path / "json/operations")).columns
