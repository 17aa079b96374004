"""Ranged reads, decoded images, the stored cache, observed counters, thresholds by a forest."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.functions import fingerprint
from shutterloom.operators import components, dedup
from shutterloom.plans import organise
from shutterloom.sources import catalogue, ranges
from shutterloom.sources.cache_store import CacheStore

KIB = 1024


def quick(data):
    tail = data[-256 * KIB :] if len(data) > 512 * KIB else b""
    return hashlib.sha256(len(data).to_bytes(8, "little") + data[: 256 * KIB] + tail).hexdigest()


def movie(raw, wide=False):
    return b"mvhd" + (b"\x01\0\0\0" + raw.to_bytes(8, "big") if wide else b"\0\0\0\0" + raw.to_bytes(4, "big"))


def test_ends_of_files(spark, tmp_path):
    """Sizes around the bounds; a header at the start, at the end, across the middle; missing files don't stop others."""
    rng = random.Random(1)
    sizes = [0, 1, 200 * KIB, 256 * KIB, 256 * KIB + 1, 512 * KIB, 512 * KIB + 1, 700 * KIB, 1024 * KIB, 1024 * KIB + 1, 1600 * KIB]
    made = {}
    for i, n in enumerate(sizes):
        for k, at in enumerate((0, n // 2, max(0, n - 20))):
            data = bytearray(rng.randbytes(n))
            head = movie(2082844800 + i, k == 1)
            if n >= len(head):
                data[at : at + len(head)] = head
            path = tmp_path / f"{i}-{k}.mov"
            path.write_bytes(data)
            made[str(path)] = bytes(data)
    files = spark.createDataFrame([(p, len(d)) for p, d in made.items()] + [(str(tmp_path / "none"), 5), (None, 5)], "path string, file_size long")
    got = {r.path: r for r in ranges.signatures(files, probe=True).collect()}
    hashed = {r.path: r for r in ranges.hashes(files).collect()}
    for p, data in made.items():
        head, tail = data[: 512 * KIB], data[-512 * KIB :] if len(data) > 512 * KIB else b""
        assert (got[p].file_size, got[p].quick_signature, got[p].header_seconds) == (len(data), quick(data), ranges.header_seconds(head, tail)), p
        assert hashed[p].content_hash == hashlib.sha256(data).hexdigest() and hashed[p].bytes_read == len(data)
        assert got[p].bytes_read == min(len(data), 1024 * KIB) and got[p].error is None
    assert got[str(tmp_path / "none")].error and got[None].error and hashed[None].content_hash is None
    plain = {r.path: r for r in ranges.signatures(files).collect()}
    assert all(plain[p].quick_signature == got[p].quick_signature and plain[p].bytes_read == min(len(d), 512 * KIB) for p, d in made.items())


def test_a_file_beyond_two_gibibytes(spark, tmp_path):
    """Three GiB, most of them a hole: its ends cost one MiB, its hash is made in pieces."""
    path = tmp_path / "long.mp4"
    size = 3 << 30
    with open(path, "wb") as f:
        f.write(b"start")
        f.seek(size - 4096)
        f.write(movie(3_000_000_000).ljust(4096, b"\0"))
    files = spark.createDataFrame([(str(path), size)], "path string, file_size long")
    got = ranges.signatures(files, probe=True).first()
    assert (got.file_size, got.header_seconds, got.bytes_read) == (size, 3_000_000_000, 1024 * KIB)
    assert ranges.container_times(files).first().created_seconds == 3_000_000_000 - 2082844800
    want, zeros = hashlib.sha256(b"start".ljust(4 << 20, b"\0")), bytes(4 << 20)
    for _ in range((size >> 22) - 2):
        want.update(zeros)
    want.update(bytes((4 << 20) - 4096) + movie(3_000_000_000).ljust(4096, b"\0"))
    whole = ranges.hashes(files).first()
    assert (whole.content_hash, whole.bytes_read) == (want.hexdigest(), size)


def test_only_files_with_equal_signatures_are_read_whole(spark, tmp_path, monkeypatch):
    """Two files that differ in the middle only are told apart; others aren't opened at all."""
    rng = random.Random(2)
    base = rng.randbytes(900 * KIB)
    other = base[: 400 * KIB] + b"?" + base[400 * KIB + 1 :]
    for name, data in (("a.jpg", base), ("b.jpg", base), ("c.jpg", other), ("d.jpg", base[:-1])):
        (tmp_path / name).write_bytes(data)
    listed = catalogue.list_files(spark, str(tmp_path))
    signed = ranges.signatures(listed).select("path", "file_size", "quick_signature")
    signed = spark.createDataFrame(signed.collect(), signed.schema)
    opened = ranges.hashes
    asked = []
    monkeypatch.setattr(ranges, "hashes", lambda files: asked.extend(r.path for r in files.collect()) or opened(files))
    got = {r.path.rsplit("/", 1)[1]: r.content_hash for r in ranges.confirmed_hashes(signed).collect()}
    assert got == {"a.jpg": hashlib.sha256(base).hexdigest(), "b.jpg": hashlib.sha256(base).hexdigest(), "c.jpg": hashlib.sha256(other).hexdigest(), "d.jpg": None}
    assert sorted(p.rsplit("/", 1)[1] for p in asked) == ["a.jpg", "b.jpg", "c.jpg"]


def test_outer_roots(spark):
    df = spark.createDataFrame([("/a/b",), ("/a",), ("/ab",), ("c/d/../e",), ("/c/e/f/",), ("/a/",)], "path string")
    assert {r.path for r in catalogue.outer_roots(df).collect()} == {"/a", "/ab", "/c/e"}


def test_large_images_are_shrunk_in_stripes():
    """Twelve megapixels as floats would take 288 MB."""
    rgb = np.random.default_rng(0).integers(0, 256, (3000, 4000, 3), np.uint8)
    tracemalloc.start()
    got = fingerprint.signatures_of_pixels(rgb)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    cells = rgb.reshape(4, 750, 4, 1000, 3).mean((1, 3))
    assert np.abs(np.array(got[1]).reshape(4, 4, 3) - cells).max() <= 0.5 + 1e-9
    small = fingerprint._shrunk(rgb[:65, :70], (32, 4))[0]
    edges = np.linspace(0, 70, 33)
    assert small.shape == (32, 32, 3) and edges[1] > 2 and np.isfinite(small).all()


CACHE = "path string, file_size long, file_modified timestamp, phash long"


def test_stored_cache(spark, tmp_path):
    rows = [(f"/p/{i}", i, None, i) for i in range(200)]
    store = CacheStore(spark, str(tmp_path / "cache"), "cache_test", 4)
    assert store.version() == -1
    with pytest.raises(ValueError):
        store.read()
    store.start(spark.createDataFrame(rows, CACHE))
    items = spark.createDataFrame([(p, n, None) for p, n, _, _ in rows] + [("/new", 1, None)], "path string, file_size long, file_modified timestamp")
    plain = catalogue.cache_lookup(items, spark.createDataFrame(rows, CACHE))
    assert sorted(map(str, store.lookup(items).collect())) == sorted(map(str, plain.collect()))
    fresh = spark.createDataFrame([("/p/3", 3, None, -3), ("/new", 1, None, -1)], CACHE)
    assert store.update(fresh, items.filter("path <> '/p/5'").select("path")) == 1
    want = catalogue.cache_upsert(spark.createDataFrame(rows, CACHE), fresh, items.filter("path <> '/p/5'").select("path"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, want.collect()))
    # an update that dies before the pointer moves is not seen; its number is written anew
    (tmp_path / "cache" / "v2").mkdir()
    assert store.version() == 1 and store.update(fresh.limit(0), items.select("path")) == 2 and store.read().count() == 200
    # another session finds the table by the pointer
    spark.sql("DROP TABLE cache_test_2")
    again = CacheStore(spark, str(tmp_path / "cache"), "cache_test", 4)
    assert again.read().count() == 200
    for n in range(3):
        spark.sql(f"DROP TABLE IF EXISTS cache_test_{n}")


def test_the_cache_side_is_not_shuffled(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"), "cache_plan", 4)
    store.start(spark.createDataFrame([(f"/p/{i}", i, None, i) for i in range(50)], CACHE))
    items = spark.range(50).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"), F.col("id").alias("file_size"), F.lit(None).cast("timestamp").alias("file_modified"))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.lookup(items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    cache_side = plan[plan.index("SelectedBucketsCount") - 800 : plan.index("SelectedBucketsCount")]
    assert "Exchange" not in cache_side.split("FileScan")[-1]
    spark.sql("DROP TABLE cache_plan_0")


def test_observed_counters_come_with_the_write(spark):
    items = spark.createDataFrame([(i, "image" if i % 4 else "other", "exif" if i % 3 else "none", None, "/a", f"{i}.jpg") for i in range(60)], "item_id int, kind string, time_source string, captured_at timestamp_ntz, parent_path string, file_name string")
    rows, seen = organise.observed(organise.considered(items, organise.Filter(minimum_confidence=3)))
    rows.write.format("noop").mode("overwrite").save()
    want = organise.counters(organise.considered(items, organise.Filter(minimum_confidence=3))).first()
    assert seen.get == want.asDict()


def test_forest_joins_what_the_links_join(spark):
    """Random links with many ties: at every bound the same components, with as few links as can be."""
    rng = random.Random(6)
    edges = [(a, b, rng.randint(0, 5)) for _ in range(220) for a, b in [rng.sample(range(120), 2)]]
    df = spark.createDataFrame(edges, "a int, b int, distance int")
    forest = components.spanning_forest(df)
    kept = forest.collect()
    groups = lambda links: {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
    for bound in (0, 2, 5):
        whole = groups(df.filter(F.col("distance") <= bound))
        assert groups(spark.createDataFrame(kept, forest.schema).filter(F.col("distance") <= bound)) == whole
    assert len(kept) == len(whole) - len(set(whole.values()))


def test_thresholds_by_a_forest(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(i, "image", f"sha:{i if i % 9 else 0}", "exif", 10, 10, i, f"/l/{i}.jpg", rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 18))), None) for i in range(120)]
    items = spark.createDataFrame(rows, "item_id long, kind string, identity string, time_source string, width int, height int, file_size long, path string, phash long, color_sig array<short>")
    linked = dedup.linked_images(items)
    for threshold in (6, 20):
        for one, two in zip(dedup.recluster(items, threshold), dedup.recluster_linked(items, linked, threshold), strict=True):
            assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, two.select(sorted(two.columns)).collect()))


def test_tasks_list_what_spark_lists(spark, tmp_path):
    """Nested folders, hidden names; many files make few tasks."""
    for name in ("a.jpg", "d/e/f/b c%20.mp4", "d/.h/x.jpg", "_t/x.jpg", "k=1/_p=2/y.jpg", "d/_metadata", "d/.z.jpg", "d/w._COPYING_", *[f"many/{i}.jpg" for i in range(300)]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "empty").mkdir()
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).selectExpr("regexp_replace(path, '^file:/*', '/') AS path", "length", "modificationTime")
    for root in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        got = catalogue.list_files(spark, root)
        assert sorted(map(tuple, got.select("path", "file_size", "file_modified").collect())) == sorted(map(tuple, want.collect()))
        assert got.rdd.getNumPartitions() < 100
