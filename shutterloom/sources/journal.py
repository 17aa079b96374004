"""Journals and exports: JSON lines in and out, sessions, CSV and JSON plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom import schema
from shutterloom.scratch import checkpointed

_DEFAULTS = {"kind": "move", "result": "failed", "message": "", "fileSize": 0, "undone": False, "sourcePath": ""}


#: Folders that sessions are dealt to by their id; a folder a session would be as many files as sessions times tasks.
BUCKETS = 64


def _write(journal: DataFrame, path: str, mode: str) -> None:
    """Entries into the buckets of their sessions, a few files each."""
    dealt = journal.withColumn("bucket", _bucket())
    # large buckets are split and small ones stay one file
    dealt.hint("rebalance", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(BUCKETS)).cast("int")


def append(journal: DataFrame, path: str) -> None:
    """Add entries to a folder of JSON lines, where sessions share a bounded number of folders."""
    _write(journal, path, "append")


def rewrite(journal: DataFrame, path: str) -> None:
    """Replace the sessions that occur in `journal`; others stay. `journal` must not be read from `path` itself.

    The other sessions of the buckets that are touched are written again as
    they stand, lines that are no entries with them.
    """
    spark = journal.sparkSession
    given = checkpointed(journal)
    ids = given.select(F.col("session_id").cast("string").alias("_s")).distinct()
    touched = ids.select(F.pmod(F.xxhash64("_s"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    lines = checkpointed(spark.read.schema("value string, bucket int").text(path).join(F.broadcast(touched), "bucket"))
    told = F.get_json_object("value", "$.session_id")
    is_entry = F.get_json_object("value", "$").isNotNull()
    others = lines.join(ids, told.eqNullSafe(F.col("_s")) & is_entry, "left_anti")
    fresh = given.withColumn("session_id", F.col("session_id").cast("string"))
    new = fresh.select(F.to_json(F.struct(*fresh.columns)).alias("value"), _bucket().alias("bucket"))
    both = others.select("value", "bucket").unionByName(new)
    both.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder of JSON lines; lines that are no JSON objects go, missing fields get their defaults. Folders of single sessions (`session_id=...`) are read too."""
    rows = spark.read.schema(schema.JOURNAL_SCHEMA + ", session_id string, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "false").json(path)
    kept = rows.filter("_corrupt IS NULL").drop("_corrupt", "bucket")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in _DEFAULTS.items()}
    return kept.withColumns(filled).withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def sessions(journal: DataFrame) -> DataFrame:
    """One row a session, newest first: times, counts, bytes freed, whether anything can be undone.

    `journal` has session_id, ts, op_kind, result, undone, file_size.
    """
    done = F.col("result") == "success"
    return (
        journal.groupBy("session_id")
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("finished"),
            F.count("*").alias("entries"),
            F.count_if(done).alias("success_count"),
            F.count_if(F.col("result") == "failed").alias("failed_count"),
            F.count_if("undone").alias("undone_count"),
            F.coalesce(F.sum(F.when(done & (F.col("op_kind") == "trash") & ~F.col("undone"), F.col("file_size"))), F.lit(0)).alias("reclaimed_bytes"),
            F.coalesce(F.bool_or(done & ~F.col("undone")), F.lit(False)).alias("can_undo"),
        )
        .orderBy(F.desc("started"), "session_id")
    )


def export_csv(operations: DataFrame, path: str) -> None:
    """A plan as CSV with the seven columns of the review sheet (no byte order mark)."""
    shown = operations.orderBy("op_ordinal").select(
        F.when(F.col("selected"), "是").otherwise("否").alias("执行"),
        F.col("op_kind").alias("类型"),
        F.col("file_name").alias("文件名"),
        F.col("source_path").alias("源路径"),
        F.coalesce("destination_path", F.lit("")).alias("目标路径"),
        F.col("reason").alias("原因"),
        F.col("file_size").alias("体积"),
    )
    shown.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_json(operations: DataFrame, summary: DataFrame, warnings: DataFrame, path: str) -> None:
    """A plan as three folders of JSON lines: operations (without null fields), summary, warnings."""
    for name, rows in (("operations", operations), ("summary", summary), ("warnings", warnings)):
        rows.write.mode("overwrite").json(f"{path}/{name}")
