"""From files or tables to the media catalogue: scan, exclusions, failures, fingerprint cache."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterloom.functions import capture, text
from shutterloom.scratch import checkpointed

from .ranges import PROBE_BYTES, header_seconds

#: Fixed value: default size floor.
LEAST_BYTES = 1024
#: Endings of folders that count as packages.
PACKAGE_SUFFIXES = (".app", ".bundle", ".framework", ".photoslibrary", ".photolibrary", ".imovielibrary", ".fcpbundle", ".lrlibrary", ".aplibrary")


@dataclass(frozen=True)
class ScanSettings:
    include_images: bool = True
    include_videos: bool = True
    minimum_bytes: int = LEAST_BYTES
    skip_hidden: bool = True
    skip_packages: bool = True


def roots(paths: Sequence[str]) -> list[str]:
    """Source roots, `.` and `..` resolved, without those that lie in another one."""
    kept: list[str] = []
    for p in sorted({posixpath.normpath("/" + p.lstrip("/")) for p in paths}, key=lambda p: (len(p), p)):
        if not any(p == k or p.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(p)
    return kept


def outer_roots(paths: DataFrame) -> DataFrame:
    """`roots` of a table (path): rows without those that lie in another one; an equi-join on the folders above."""
    tidy = paths.select(text.normalize_path(F.concat(F.lit("/"), F.col("path"))).alias("path")).distinct()
    above = tidy.select("path", F.explode(text.ancestors(F.col("path"))).alias("x")).filter("x <> path")
    inside = above.join(tidy.select(F.col("path").alias("x")), "x", "left_semi").select("path").distinct()
    return tidy.join(inside, "path", "left_anti")


#: Rows of a batch of a listing.
_LISTED = 10_000


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in each folder (path), without names that Spark's own listing leaves out."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "size", "millis", "is_folder"])
    rows: list[tuple] = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            with os.scandir(folder) as entries:
                for e in entries:
                    if (e.name[0] in "._" and not (e.name[0] == "_" and "=" in e.name)) or e.name.endswith("._COPYING_"):
                        continue
                    stat = e.stat()
                    rows.append((e.path, stat.st_size, stat.st_mtime_ns // 1_000_000, e.is_dir()))
                    if len(rows) == _LISTED:
                        yield batch_of(rows)
                        rows = []
    yield batch_of(rows)


def _walked(spark: SparkSession, root: str) -> DataFrame:
    """The files below a local folder, listed by tasks, a level of folders at a time; neither names nor sizes pass the driver."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, files = spark.createDataFrame([(root,)], "path string"), []
    while True:
        found = checkpointed(folders.repartition(tasks, "path").mapInArrow(_children, "path string, size long, millis long, is_folder boolean"))
        files.append(found.filter("NOT is_folder"))
        folders = found.filter("is_folder").select("path")
        if not folders.take(1):
            break
    all_files = files[0]
    for level in files[1:]:
        all_files = all_files.unionByName(level)
    return all_files.select("path", F.col("size").alias("length"), F.timestamp_millis("millis").alias("modificationTime"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root: path, file_size, file_modified. No content is read.

    Folders that all machines see under a local path are listed by tasks, other
    stores by Spark's `binaryFile`, which holds the listing in the driver.
    Files and folders whose names begin with `.` or `_` are left out, as Spark
    does; a listing made elsewhere can hold them, `scan` then decides.
    """
    local = "/" + root.removeprefix("file:").strip("/")
    if (root.startswith("/") or root.startswith("file:/")) and not re.search(r"[\\*?\[\]{}]", root) and os.path.isdir(local):
        files = _walked(spark, local)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace(F.col("path"), "^file:/*", "/").alias("path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modified"), F.lit(local).alias("source_root"))


def hidden(relative: Column) -> Column:
    return F.exists(F.split(relative, "/"), lambda s: s.startswith("."))


def in_package(relative: Column, suffixes: Sequence[str] = PACKAGE_SUFFIXES) -> Column:
    """Whether a folder (not the file itself) below the root is a package."""
    parts = F.split(F.lower(relative), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    ends = lambda s: F.exists(F.array(*[F.lit(x) for x in suffixes]), lambda x: F.endswith(s, x))
    return (F.size(parts) > 1) & F.exists(folders, ends)


def without_excluded(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Files that no excluded folder (path) holds: an equi-join on the folders above a file, so it doesn't grow with their product."""
    marks = exclusions.select(F.col("path").alias("x")).distinct()
    hit = files.select("path", F.explode(text.ancestors(F.col("path"))).alias("x")).join(marks, "x", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def first_by_path(files: DataFrame) -> DataFrame:
    """One row a path: the one with the smallest source root, then the largest size."""
    order = Window.partitionBy("path").orderBy("source_root", F.desc("file_size"))
    return files.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def scan(files: DataFrame, settings: ScanSettings = ScanSettings(), exclusions: DataFrame | None = None) -> DataFrame:
    """Catalogue rows of files (path, file_size, source_root): visual media of enough bytes, once each."""
    rows = files.withColumn("kind", text.kind_of(text.file_name(F.col("path"))))
    wanted = [k for k, on in (("image", settings.include_images), ("video", settings.include_videos)) if on]
    rows = rows.filter(F.col("kind").isin(*wanted) if wanted else F.lit(False)).filter(F.col("file_size") >= settings.minimum_bytes)
    relative = F.coalesce(text.relative_path(F.col("path"), F.col("source_root")), text.file_name(F.col("path")))
    if settings.skip_hidden:
        rows = rows.filter(~hidden(relative))
    if settings.skip_packages:
        rows = rows.filter(~in_package(relative))
    if exclusions is not None:
        rows = without_excluded(rows, exclusions)
    return first_by_path(rows).withColumns({"item_id": F.sha2("path", 256), "file_name": text.file_name(F.col("path")), "parent_path": text.parent(F.col("path"))})


def failures(items: DataFrame) -> DataFrame:
    return items.filter("error IS NOT NULL").select("path", F.col("error").alias("message"))


def cache_lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """`items` with is_hit and the cached columns: same path and size, and no known change of time of 2 seconds or more. A hit clears the error."""
    stored = cache.select(F.col("path").alias("_p"), F.col("file_size").alias("_s"), F.col("file_modified").alias("_m"), *[c for c in cache.columns if c not in ("path", "file_size", "file_modified")])
    near = F.col("file_modified").isNull() | (F.abs(F.col("file_modified").cast("double") - F.col("_m").cast("double")) < 2.0)
    fresh = items.drop(*[c for c in stored.columns if c in items.columns])
    # the path alone is the join's key, so that a cache that lies by path stays where it is
    same_size = F.coalesce(F.col("file_size") == F.col("_s"), F.lit(False))
    out = fresh.join(stored, (F.col("path") == F.col("_p")) & same_size & near, "left").withColumn("is_hit", F.col("_p").isNotNull()).drop("_p", "_s", "_m")
    return out.withColumn("error", F.when(~F.col("is_hit"), F.col("error"))) if "error" in items.columns else out


def cache_upsert(cache: DataFrame, fresh: DataFrame, live: DataFrame) -> DataFrame:
    """The next version of the cache: fresh entries replace those of their path; entries whose path isn't live go."""
    kept = cache.join(fresh.select("path"), "path", "left_anti").unionByName(fresh.select(*cache.columns))
    return kept.join(live.select("path"), "path", "left_semi")


def container_times(videos: DataFrame) -> DataFrame:
    """Rows (path, created_seconds) from rows with the `content` of videos: the creation time of the movie header, looked for in both ends. `ranges.container_times` reads the ends of files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_seconds(h or b"", t or b"") for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["path", "raw"])

    ends = videos.select("path", F.substring("content", 1, PROBE_BYTES), F.when(F.octet_length("content") > PROBE_BYTES, F.substring("content", -PROBE_BYTES, PROBE_BYTES)))
    return ends.mapInArrow(run, "path string, raw long").select("path", capture.mac_epoch_to_seconds(F.col("raw")).alias("created_seconds"))
