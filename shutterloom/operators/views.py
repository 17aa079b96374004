"""Views of a catalogue: totals, histograms, folder trees, search and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom import schema
from shutterloom.functions import text


def totals(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if(F.col("kind") == "video").alias("videos"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("captured_at").isNull() | (F.col("time_source") == "none")).alias("unknown_time"),
        F.count_if(F.col("time_source") == "fileSystem").alias("filesystem_time"),
    )


def year_histogram(items: DataFrame) -> DataFrame:
    return items.filter("captured_at IS NOT NULL").groupBy(F.year("captured_at").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def device_counts(items: DataFrame) -> DataFrame:
    make = F.col("make") if "make" in items.columns else F.lit(None).cast("string")
    return items.groupBy(text.camera_label(make, F.col("model")).alias("device")).agg(F.count("*").alias("n"))


def device_histogram(items: DataFrame, top: int = 8) -> DataFrame:
    return device_counts(items).orderBy(F.desc("n"), "device").limit(top)


def search(items: DataFrame, keyword: str) -> DataFrame:
    """Items with the keyword (any case, blanks at its ends off) in name, folder or device; all for an empty one."""
    wanted = keyword.strip().lower()
    if not wanted:
        return items
    parts = [F.contains(F.lower(c), F.lit(wanted)) for c in (F.col("file_name"), F.col("parent_path"), text.camera_label(F.col("make"), F.col("model")))]
    return items.filter(parts[0] | parts[1] | parts[2])


def sort(items: DataFrame, by: str = "capturedDesc") -> DataFrame:
    """capturedDesc, capturedAsc (items without a time last in both), name or sizeDesc."""
    keys = {"capturedDesc": [F.desc_nulls_last("captured_at")], "capturedAsc": [F.asc_nulls_last("captured_at")], "name": [], "sizeDesc": [F.desc("file_size")]}[by]
    rest = [F.col(c) for c in ("file_name", "path", "item_id") if c in items.columns]
    return items.orderBy(*keys, *rest)


def folder_tree(items: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Folders from the source root down: direct and whole-tree counts and bytes, own and inherited exclusion.

    `items` has source_root, parent_path, file_size; `exclusions` has path.
    Folders without files of their own are filled in.
    """
    below = F.filter(text.ancestors(F.col("parent_path")), lambda p: text.is_under(p, F.col("source_root")))
    sizes = items.groupBy("source_root", "parent_path").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    spread = sizes.select("source_root", "parent_path", "n", "b", F.explode(below).alias("path"))
    own = F.col("path") == F.col("parent_path")
    folders = spread.groupBy("source_root", "path").agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("file_count"),
        F.sum(F.when(own, F.col("b")).otherwise(0)).alias("bytes"),
        F.sum("n").alias("total_file_count"),
        F.sum("b").alias("total_bytes"),
    )
    folders = folders.withColumn("name", text.file_name(F.col("path"))).withColumn("depth", text.path_depth(F.col("path")) - text.path_depth(F.col("source_root")))
    if exclusions is None:
        return folders.withColumns({"is_excluded": F.lit(False), "is_inherited": F.lit(False)})
    marks = exclusions.select(F.col("path").alias("x")).distinct()
    met = folders.select("source_root", "path", F.explode(text.ancestors(F.col("path"))).alias("x")).join(marks, "x").groupBy("source_root", "path").agg(F.bool_or(F.col("x") == F.col("path")).alias("is_excluded"), F.bool_or(F.col("x") != F.col("path")).alias("is_inherited"))
    return folders.join(met, ["source_root", "path"], "left").withColumns({"is_excluded": F.coalesce("is_excluded", F.lit(False)), "is_inherited": F.coalesce("is_inherited", F.lit(False))})


def child_counts(folders: DataFrame) -> DataFrame:
    """Folders with the number of their direct children."""
    counts = folders.filter("depth > 0").groupBy("source_root", text.parent(F.col("path")).alias("path")).agg(F.count("*").alias("children"))
    return folders.join(counts, ["source_root", "path"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def visible_folders(folders: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Folders without a collapsed (path) folder above them."""
    above = folders.select("source_root", "path", F.explode(text.ancestors(text.parent(F.col("path")))).alias("x"))
    hidden = above.join(collapsed.select(F.col("path").alias("x")).distinct(), "x", "left_semi").select("source_root", "path").distinct()
    return folders.join(hidden, ["source_root", "path"], "left_anti")


def has_children(folders: DataFrame) -> DataFrame:
    """Folders with whether any other lies directly in them."""
    return child_counts(folders).withColumn("has_children", F.col("children") > 0).drop("children")


def root_totals(items: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Files, bytes and excluded files per source root; a file is excluded if any folder above it is."""
    folders = items.groupBy("source_root", "parent_path").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    marks = exclusions.select(F.col("path").alias("x")).distinct()
    out = folders.select("source_root", "parent_path", F.explode(text.ancestors(F.col("parent_path"))).alias("x")).join(marks, "x", "left_semi").select("source_root", "parent_path").distinct().withColumn("out", F.lit(True))
    joined = folders.join(out, ["source_root", "parent_path"], "left")
    return joined.groupBy("source_root").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("excluded_files"))


def toggle_exclusion(exclusions: DataFrame, path: str) -> DataFrame:
    """Listed folders after a click on `path`: off if listed; else on, and the listed ones below it go."""
    here = F.lit(path)
    if exclusions.filter(F.col("path") == here).limit(1).count():
        return exclusions.filter(F.col("path") != here).select("path")
    rest = exclusions.filter(~text.is_under(F.col("path"), here)).select("path")
    return rest.unionByName(exclusions.sparkSession.createDataFrame([(path,)], "path string"))


def stats(items: DataFrame, dedup_summary: DataFrame) -> DataFrame:
    """One row: a scan's counts beside its duplicate summary."""
    one = F.lit(1).alias("_one")
    return totals(items).select("*", one).join(dedup_summary.select("*", one), "_one").drop("_one")


def confidence(items: DataFrame) -> DataFrame:
    return items.withColumn("time_confidence", schema.confidence(F.col("time_source")))
