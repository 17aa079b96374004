"""The fingerprint cache kept up to date from a stream of scanned items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shutterloom.sources.catalogue import cache_lookup

#: After so many batches the changes since the last whole version become a new one.
COMPACT = 20


def start(cache: DataFrame, root: str) -> None:
    """Write the whole version that batches build on; it may be empty."""
    cache.write.mode("overwrite").parquet(f"{root}/whole/v=-1")


def version(spark: SparkSession, root: str, number: int) -> DataFrame:
    """The cache after batch `number` (-1 for the start): the last whole version and the changes since, the latest of each path."""
    whole = (number + 1) // COMPACT * COMPACT - 1
    rows = spark.read.parquet(f"{root}/whole/v={whole}")
    columns = rows.columns
    rows = rows.withColumn("_v", F.lit(-1))
    for n in range(whole + 1, number + 1):
        rows = rows.unionByName(spark.read.parquet(f"{root}/changes/v={n}").withColumn("_v", F.lit(n)))
    if number == whole:
        return rows.drop("_v")
    latest = rows.groupBy("path").agg(F.max_by(F.struct(*columns), "_v").alias("r"))
    return latest.select("r.*")


def maintain(items: DataFrame, root: str, fingerprint: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """For each micro-batch of `items`: fingerprint what the newest version misses and write that as its changes.

    What a batch writes follows its size, not the cache's; every COMPACT
    batches a whole version is written. A batch that is run again overwrites
    its own files, so the result is the same after a restart.
    """

    def step(batch: DataFrame, number: int) -> None:
        cache = version(batch.sparkSession, root, number - 1)
        missing = cache_lookup(batch, cache).filter("NOT is_hit").select(*batch.columns)
        fingerprint(missing).select(*cache.columns).write.mode("overwrite").parquet(f"{root}/changes/v={number}")
        if (number + 1) % COMPACT == 0:
            changes = batch.sparkSession.read.parquet(f"{root}/changes/v={number}")
            whole = cache.join(changes.select("path"), "path", "left_anti").unionByName(changes)
            whole.write.mode("overwrite").parquet(f"{root}/whole/v={number}")

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
