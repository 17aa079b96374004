"""Numbers that tell equal names apart: `name_1.jpg`, `name_2.jpg`, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.functions import text
from shutterloom.operators.components import connected_components
from shutterloom.scratch import checkpointed, numbered

_NUMBERED = r"^(.+)_([1-9]\d{0,17})$"


def suffixed(name: Column, number: Column) -> Column:
    """`name` with `_number` before its ending."""
    ext = text.raw_extension(name)
    return F.concat(text.stem(name), F.lit("_"), number.cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))


def without_number(names: DataFrame, name: str) -> DataFrame:
    """Of `names` those that a number may have made from another name: base_name and the number are added."""
    ext = text.raw_extension(F.col(name))
    made = names.filter(F.contains(F.col(name), F.lit("_"))).withColumn("_stem", F.regexp_extract(text.stem(F.col(name)), _NUMBERED, 1)).filter("_stem <> ''")
    return made.withColumn("base_name", F.concat("_stem", F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))).withColumn("number", F.regexp_extract(text.stem(F.col(name)), _NUMBERED, 2).cast("long")).drop("_stem")


def free_numbers(wanting: DataFrame, disk: DataFrame, keys: list[str]) -> DataFrame:
    """`wanting` with the turn-th number that no file on `disk` (disk_dir, disk_name) has: adds `number`.

    `keys` end with target_dir and desired_name; `turn` runs from 1 inside them.
    Taken and wanted numbers are merged into one order: the i-th taken number d
    of a name has d - i free ones before it, and goes behind the turns up to
    that many. The place in this order is the number, and it is found in parts,
    however many numbers of a name are taken or wanted.
    """
    asked = wanting.select(*keys).distinct()
    numbers = without_number(disk, "disk_name").select(F.col("disk_dir").alias("target_dir"), F.col("base_name").alias("desired_name"), "number").distinct()
    taken = checkpointed(numbers.join(asked, ["target_dir", "desired_name"]).select(*keys, "number"))
    if not taken.take(1):
        return wanting.withColumn("number", F.col("turn").cast("long"))
    placed = numbered(taken, keys, [F.asc("number")], "_i").select(*keys, (F.col("number") - F.col("_i")).alias("_place"), F.lit(True).alias("_taken"), F.col("number").alias("_tie"))
    merged = wanting.withColumns({"_place": F.col("turn").cast("long"), "_taken": F.lit(False), "_tie": F.lit(0).cast("long")}).unionByName(placed, allowMissingColumns=True)
    return numbered(merged, keys, [F.asc("_place"), F.asc("_taken"), F.asc("_tie")], "number").filter("NOT _taken").drop("_place", "_taken", "_tie")


def chains(names: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows (target_dir, desired_name, component) of the wished names that a number given to another wished name may meet.

    `names` has a row for each wished name of a folder: n rows wish it, `wants`
    if one of them needs a number for sure. A name's numbers can't go beyond
    its rows, its numbers on `disk` and its numbers among the wished names
    taken together; only a wished name within that reach is linked to it, and
    only if the name needs numbers, for sure or because a number may meet it.
    """
    made = without_number(names.select("target_dir", "desired_name"), "desired_name").withColumnRenamed("desired_name", "made")
    bases = names.select("target_dir", F.col("desired_name").alias("base_name"), "n", "wants")
    links = checkpointed(made.join(bases, ["target_dir", "base_name"]))
    if not links.take(1):
        return links.select("target_dir", F.col("made").alias("desired_name"), F.lit("").alias("component"))
    wished = links.groupBy("target_dir", "base_name").agg(F.count("*").alias("wished"))
    numbers = without_number(disk, "disk_name").select(F.col("disk_dir").alias("target_dir"), "base_name", "number").distinct()
    taken = numbers.join(wished.select("target_dir", "base_name"), ["target_dir", "base_name"], "left_semi").groupBy("target_dir", "base_name").agg(F.count("*").alias("taken"))
    reach = wished.join(taken, ["target_dir", "base_name"], "left")
    near = links.join(reach, ["target_dir", "base_name"]).filter(F.col("number") <= F.col("n") + F.col("wished") + F.coalesce("taken", F.lit(0)))
    path = lambda name: text.child(F.col("target_dir"), F.col(name))
    near = checkpointed(near.select(path("base_name").alias("base"), path("made").alias("made"), "wants"))
    active, n = near.filter("wants").select("base", "made"), -1
    while True:
        active = checkpointed(active)
        n, before = active.count(), n
        if n in (0, before):
            break
        met = active.select(F.col("made").alias("base")).unionByName(active.select("base")).distinct()
        active = near.join(met, "base", "left_semi").select("base", "made")
    groups = connected_components(active, "base", "made")
    return groups.select(text.parent(F.col("node")).alias("target_dir"), text.file_name(F.col("node")).alias("desired_name"), "component")
