"""The fingerprint cache as bucketed tables behind a pointer.

Each version is a table bucketed and sorted by path, so that a lookup shuffles
the scan and not the cache, and the next version is made bucket by bucket. The
pointer is a small folder to which a version's number is appended once the
table is complete; readers take the largest, so an update that fails midway
changes nothing, and one that is repeated writes its own table anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import cache_lookup


class CacheStore:
    """A cache (path, file_size, file_modified and what is remembered) in the folder `root`; `name` is the prefix of its tables in the session's catalog."""

    def __init__(self, spark: SparkSession, root: str, name: str = "fingerprint_cache", buckets: int = 64):
        self.spark, self.root, self.name, self.buckets = spark, root.rstrip("/"), name, buckets

    def version(self) -> int:
        """The number of the version that readers see; -1 before the first."""
        pointer = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointer")
        if not pointer.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(pointer):
            return -1
        return self.spark.read.schema("version long").parquet(f"{self.root}/pointer").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def _write(self, rows: DataFrame, number: int) -> None:
        table = f"{self.name}_{number}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        placed = rows.repartition(self.buckets, "path")  # a file for each bucket
        placed.write.mode("overwrite").bucketBy(self.buckets, "path").sortBy("path").option("path", f"{self.root}/v{number}").saveAsTable(table)
        self.spark.range(1).select(F.lit(number).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")

    def read(self) -> DataFrame:
        """The current version. Its table is listed in this session's catalog if another session has written it."""
        number = self.version()
        if number < 0:
            raise ValueError(f"no cache in {self.root}")
        table = f"{self.name}_{number}"
        if not self.spark.catalog.tableExists(table):
            stored = self.spark.read.parquet(f"{self.root}/v{number}")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {self.buckets} BUCKETS LOCATION '{self.root}/v{number}'")
        return self.spark.table(table)

    def start(self, rows: DataFrame) -> None:
        """The first version; `rows` may be empty."""
        self._write(rows, self.version() + 1)

    def lookup(self, items: DataFrame) -> DataFrame:
        """`items` with is_hit and the cached columns, as `catalogue.cache_lookup` gives them; the cache isn't shuffled."""
        return cache_lookup(items.repartition(self.buckets, "path"), self.read())

    def update(self, fresh: DataFrame, live: DataFrame) -> int:
        """The next version: fresh entries (one a path) replace those of their path, entries whose path isn't `live` go. Gives its number.

        A full join and a semi-join on the paths' buckets: only `fresh` and
        `live` are shuffled.
        """
        old, number = self.read(), self.version() + 1
        new = fresh.select(F.col("path").alias("_path"), F.struct(*old.columns).alias("_new")).repartition(self.buckets, "_path")
        both = old.withColumn("_old", F.struct(*old.columns)).select("path", "_old").join(new, F.col("path") == F.col("_path"), "full")
        rows = both.select(F.coalesce("_path", "path").alias("_p"), F.coalesce("_new", "_old").alias("r"))
        kept = rows.join(live.select(F.col("path").alias("_l")).distinct(), F.col("_p") == F.col("_l"), "left_semi")
        self._write(kept.select("r.*"), number)
        return number
