"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Tables with more rows than this are never broadcast by a guess of their size.
BROADCAST_ROWS = 1 << 17
#: Tables of paths with so many rows at most are sent to every task.
FEW_ROWS = 1 << 16
#: Rows of one group that a join gives to one task.
ROWS_OF_GROUP = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, or the one that the session has set.

    Only a session on one machine (tests, a laptop) without either gets a
    temporary folder; elsewhere executors wouldn't see it, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='shutterloom-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read from there: its lineage is cut, and lost executors lose nothing of it.

    Spark goes on with the size that it guessed for `df`, which knows nothing
    of what generators, joins or Arrow functions make of their rows, and would
    send a large table through the driver to broadcast it. So rows are counted
    on the way, and tables with many ask for joins by sorting.
    """
    out, rows = counted(df)
    return out.hint("merge") if rows > BROADCAST_ROWS else out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df` as `checkpointed` writes it, but without a hint, and its number of rows."""
    shared_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    return out, seen.get["rows"]


def with_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, few: bool, by: str, most: int = ROWS_OF_GROUP) -> DataFrame:
    """`rows` with the other columns of `facts`, which has one row for each group of `keys` and its number of rows (`size`).

    Few facts go to every task and no row moves. Else groups of more than
    `most` rows are dealt by the column `by` to several tasks, each with the
    facts; there are fewer such groups than a `most`-th of the rows. Rows with
    a null key are dropped.
    """
    if few:
        return rows.join(F.broadcast(facts.drop(size)), keys)
    parts = F.ceil(F.col(size) / most)
    large = checkpointed(facts.filter(F.col(size) > most).select(*keys, parts.alias("_parts")))
    if not large.take(1):
        return rows.join(facts.drop(size), keys)
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce(F.col("_parts").cast("long"), F.lit(1).cast("long")))).drop("_parts")
    spread = facts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop(size)
    return dealt.join(spread, [*keys, "_part"]).drop("_part")


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """`rows` with a running number from 1 inside each group of `keys`, in `order`.

    Rows are dealt by ranges of keys and order, so a group of any size is
    ranked in parts; the number of a group's rows in earlier parts is added.
    `order` must tell all rows of a group apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges are sampled, so they must not be drawn twice
    parts = checkpointed(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = counts.filter("_before > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before")
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on &= same(k, f"_k{i}")
    ranked = parts.withColumn("_r", F.row_number().over(own)).join(before, on, "left")
    return ranked.withColumn(name, (F.col("_r") + F.coalesce("_before", F.lit(0))).cast("long")).select(*[F.col(f"`{c}`") for c in rows.columns], name)
