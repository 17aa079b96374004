"""Operations whose order matters to each other: found by the places that they share, and put into components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.operators.components import connected_components
from shutterloom.scratch import checkpointed


def entangled(touches: DataFrame) -> DataFrame:
    """Rows (entry, component, node) of the entries that must be gone through in order, with all places of theirs.

    `touches` (entry long, node string, reads, fills, leaves, forced booleans)
    says what an entry does at a place. A place is crossed if it has several
    entries and one leaves it, or one only reads it and another fills it, or if
    a touch is forced. Entries at a crossed place are entangled; so are, in
    turn, all that meet one of them at a place that either changes. What only
    fills a place together with others is left to columns: the first one has it.
    """
    flags = ("reads", "fills", "leaves", "forced")
    touches = checkpointed(touches)
    places = touches.groupBy("node").agg(*[F.max(c).alias(c) for c in flags], (F.min("entry") < F.max("entry")).alias("several"))
    crossed = F.col("forced") | (F.col("several") & (F.col("leaves") | (F.col("reads") & F.col("fills"))))
    met = checkpointed(places.withColumn("crossed", crossed).filter("crossed OR (several AND (fills OR leaves))").select("node", "crossed"))
    once = touches.select("entry", "node").distinct()
    if not met.filter("crossed").take(1):
        return once.sparkSession.createDataFrame([], "entry long, component long, node string")
    meeting = checkpointed(once.join(met, "node"))
    reached = checkpointed(meeting.filter("crossed").select("entry").distinct())
    n = reached.count()
    while True:
        tainted = meeting.join(reached, "entry", "left_semi").select("node").distinct()
        reached = checkpointed(meeting.join(tainted, "node", "left_semi").select("entry").distinct())
        n, before = reached.count(), n
        if n == before:
            break
    own = meeting.join(reached, "entry", "left_semi").select("entry", "node")
    heads = own.groupBy(F.col("node").alias("_n")).agg(F.min("entry").alias("head"))
    groups = connected_components(own.join(heads, F.col("node") == F.col("_n")).select("entry", "head"), "entry", "head")
    named = groups.select(F.col("node").alias("entry"), "component")
    return checkpointed(once.join(named, "entry").select("entry", "component", "node"))
