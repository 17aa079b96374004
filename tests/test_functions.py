import struct
import zlib
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import check
from pyspark.sql import functions as F

import shutterloom.function_queries  # noqa: F401 - registers its queries
from shutterloom.functions import capture, fingerprint, templates, text
from shutterloom.queries import QUERIES, SQL


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()[0]


NAMES = {
    "IMG_20240315_143022.jpg": "2024-03-15 14:30:22",
    "PXL_20240315_143022123.jpg": "2024-03-15 14:30:22",
    "2024-03-15 14.30.22.jpg": "2024-03-15 14:30:22",
    "2024-03-15 14:30:22.jpg": "2024-03-15 14:30:22",
    "20240315-143022.jpg": "2024-03-15 14:30:22",
    "2024.03.15_143022.jpg": "2024-03-15 14:30:22",
    "Screenshot 2024-08-12 at 22.10.04.png": "2024-08-12 22:10:04",
    "VID_20240315_235959.mp4": "2024-03-15 23:59:59",
    "IMG_20240315.jpg": None,
    "DSC_8912.jpg": None,
    "IMG_20241315_143022.jpg": None,
    "IMG_20230230_101112.jpg": None,
}


def test_times_from_names(spark):
    df = spark.createDataFrame(list(NAMES.items()), "name string, want string")
    for r in df.select("name", "want", text.captured_label(capture.capture_ts_from_name(F.col("name"))).alias("got")).collect():
        assert r.got == r.want, r.name


def test_exif_times(spark):
    given = {"2023:05:10 12:00:00": "2023-05-10 12:00:00", " 2023-05-10T12:00:60 ": "2023-05-10 12:00:59", "2023:02:30 12:00:00": None, "2023:05:10": None, "1969:05:10 12:00:00": None, "": None}
    df = spark.createDataFrame([*given.items(), (None, None)], "t string, want string")
    for r in df.select("t", "want", text.captured_label(capture.parse_exif_ts(F.col("t"))).alias("got")).collect():
        assert r.got == r.want, r.t


GOLDEN = ["2023/05/05-10/Apple iPhone 13", "2023/05/05-10/图片", "2023/05/05-10", "2023/05-10/Apple iPhone 13", "2023/05-10/图片", "2023/05-10", "05-10/Apple iPhone 13", "05-10/图片", "05-10"]


@pytest.fixture(scope="module")
def item(spark):
    return spark.createDataFrame([("i1", "A_original.JPG", "image", "Apple", "iPhone 13", "/lib", datetime(2023, 5, 10, 12))], "item_id string, file_name string, kind string, make string, model string, source_root string, captured_at timestamp_ntz")


def test_folder_presets(item):
    names = templates.variables(templates.Fields.of(item.columns, F.lit(3)))
    got = item.select(*[templates.render_folder(t, names).alias(str(i)) for i, t in enumerate(templates.FOLDER_PRESETS)]).first()
    assert list(got) == GOLDEN


def test_template_edges(item):
    names = templates.variables(templates.Fields.of(item.columns, F.lit(123456)))
    got = item.select(*[templates.render(t, names).alias(str(i)) for i, t in enumerate(("{nope}-{seq}", "{orig}.{ext", "{ext}", "a{lens}{sourceFolder}", "{weekNumber}"))]).first()
    assert list(got) == ["{nope}-123456", "A_original.{ext", "jpg", "a未知镜头lib", "19"]
    assert templates.unknown_variables("{yyyy}/{nope}/{seq}") == ["nope"]


def test_week_of_year(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE'2023-01-01', 1), (DATE'2023-01-07', 1), (DATE'2023-01-08', 2), (DATE'2023-12-30', 52), (DATE'2023-12-31', 1), (DATE'2024-12-28', 52), (DATE'2024-12-29', 1), (DATE'2022-12-31', 53) AS t(d, want)")
    for r in df.select("d", "want", templates.week_of_year(F.col("d")).alias("got")).collect():
        assert r.got == r.want, r.d


def test_paths(spark):
    assert one(spark, text.normalize_path(F.col("p")), p="/a//b/./c/../d/") == "/a/b/d"
    assert one(spark, text.sanitize_component(F.col("p")), p=" a/b:c\x01 ") == "a-b-c"
    assert one(spark, text.sanitize_component(F.col("p")), p="..") == "_"
    assert one(spark, text.ancestors(F.col("p")), p="/a/b/c") == ["/a", "/a/b", "/a/b/c"]
    assert one(spark, text.parent(F.col("p")), p="/a") == "/"
    assert one(spark, text.is_under(F.col("p"), F.lit("/a/b")), p="/a/bc") is False
    assert one(spark, text.stem(F.col("p")), p=".hidden") == ".hidden"
    assert one(spark, text.duration_label(F.col("d")), d=3725.4) == "1:02:05"
    assert one(spark, text.duration_label(F.col("d")), d=-1.0) is None


def test_gps_and_meta(spark):
    la, lo = capture.gps(F.lit(1.5), F.lit("S"), F.lit(2.5), F.lit(None).cast("string"))
    assert (one(spark, la), one(spark, lo)) == (-1.5, 2.5)
    la, lo = capture.gps(F.lit(0.0), F.lit("N"), F.lit(0.0), F.lit("E"))
    assert (one(spark, la), one(spark, lo)) == (None, None)
    assert one(spark, capture.clean_meta(F.lit(" Unknown "))) is None
    assert one(spark, capture.safe_pixel(F.lit(2e6))) == 0
    assert one(spark, capture.mac_epoch_to_seconds(F.lit(2082844800))) == 0
    assert one(spark, capture.mac_epoch_to_seconds(F.lit(5))) is None


def test_fingerprints(spark):
    import hashlib

    for size in (0, 10, 256 * 1024 + 7, 512 * 1024 + 9):
        body = bytes(i % 251 for i in range(size))
        want = hashlib.sha256(size.to_bytes(8, "little") + body[: 256 * 1024] + (body[-256 * 1024 :] if size > 512 * 1024 else b"")).hexdigest()
        df = spark.createDataFrame([(bytearray(body),)], "b binary")
        assert df.select(fingerprint.quick_signature(F.col("b"))).first()[0] == want
    assert one(spark, fingerprint.colour_distance(F.array(F.lit(1), F.lit(5)), F.array(F.lit(3), F.lit(5)))) == 1.0
    assert one(spark, fingerprint.colour_distance(F.array(F.lit(1)), F.lit(None).cast("array<int>"))) == 255.0
    assert one(spark, fingerprint.hamming64(F.lit(-1), F.lit(0))) == 64
    empty = one(spark, fingerprint.frame_agreement(F.expr("cast(array() as array<bigint>)"), F.array(F.lit(1).cast("long")), 6))
    assert (empty.ratio, empty.mean) == (0.0, 64.0)
    some = one(spark, fingerprint.frame_agreement(F.expr("array(1L, 2L, 3L, -1L, -1L)"), F.expr("array(1L, 2L, 3L, 0L, 0L)"), 6))
    assert some.ratio == 0.6


def test_pixels():
    import numpy as np

    rng = np.random.default_rng(1)
    small = rng.integers(0, 255, (40, 60, 3)).astype(float)
    small = np.repeat(np.repeat(small, 8, 0), 8, 1)
    a, ca = fingerprint.signatures_of_pixels(small)
    b, cb = fingerprint.signatures_of_pixels(small[::2, ::2])
    assert a == b and ca == cb and len(ca) == 48 and any(ca)


def png(rgb):
    """A PNG file of an array (height, width, 3)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_signatures_of_image_files(spark, tmp_path):
    """Pictures decoded by Spark have the signatures of their pixels; what is no picture is left out or has none."""
    rng = np.random.default_rng(1)
    pictures = {f"p{i}.png": rng.integers(0, 256, (24 + i, 40, 3), np.uint8) for i in range(3)}
    for name, rgb in pictures.items():
        (tmp_path / name).write_bytes(png(rgb))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r for r in fingerprint.image_signatures(spark.read.format("image").load(str(tmp_path))).collect()}
    for name, rgb in pictures.items():
        assert (got[name].phash, got[name].color_sig) == fingerprint.signatures_of_pixels(rgb.astype(float))
    assert "bad.png" not in got or got["bad.png"].phash is None


def test_blanks_of_unicode_go_from_names(spark):
    rows = [("  a b ",), (" x:y/z\n",), ("　",), ("..",), ("\x01..\x02",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.sanitize_component(F.col("t"))).collect()]
    assert got == ["a b", "x-y-z", "_", "_", "_"]


def test_exif_times_need_digits_in_their_places(spark):
    rows = [("2023:05:01 12:30:60",), ("2023: 5: 1 12:00:00",), ("2023:+5:01 12:00:00",), ("2023:02:30 12:00:00",), (" 2023-05-01T12:30:00Z ",), ("2023:05:01 12:30",)]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "t string").select(capture.parse_exif_ts(F.col("t"))).collect()]
    assert got == ["2023-05-01 12:30:59", "None", "None", "None", "2023-05-01 12:30:00", "None"]


def test_midnight_as_the_end_of_a_day(spark):
    """Hour 24 is no hour; with `end_of_day` 24:00:00 alone is the next day's midnight, of days that exist."""
    rows = [("1999:12:31 24:00:00",), ("2023:02:30 24:00:00",), ("2023:05:10 24:00:60",), ("2023:05:10 24:00:01",), ("2023:05:10 24:01:00",), ("2023:05:10 23:00:00",)]
    df = spark.createDataFrame(rows, "t string")
    shown = lambda **o: [r[0] for r in df.select(text.captured_label(capture.parse_exif_ts(F.col("t"), **o))).collect()]
    assert shown() == [None] * 5 + ["2023-05-10 23:00:00"]
    assert shown(end_of_day=True) == ["2000-01-01 00:00:00", *[None] * 4, "2023-05-10 23:00:00"]


@pytest.mark.parametrize("name", ["exif_times", "resolved_times"])
def test_times_of_large_keys_equal_their_sql(spark, tmp_path, name):
    """Orders whose keys make 24:00:00, which keys below 26474 never do."""
    keys = [26474, 121024, 26475, 26474 + 94550 * 3, 26474 + 94550 * 17]
    pq.write_table(pa.table({"o_orderkey": keys, "o_orderdate": pa.array([datetime(1999, 1 + i, 28) for i in range(len(keys))], pa.timestamp("us"))}), tmp_path / "orders.parquet")
    check(spark, QUERIES[name], SQL[name], str(tmp_path))
