"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shutterloom.scratch import BROADCAST_ROWS, FEW_ROWS, checkpointed, shared_dir

#: Rounds are O(log^2 n) by theory, a handful in practice; more than this means a defect.
MOST_ROUNDS = 60
#: So many edges at most (a megabyte) are gone through in one partition, without a shuffle.
FEW_EDGES = FEW_ROWS


def _held(edges: DataFrame) -> tuple[DataFrame, bool, int]:
    """Distinct `edges` (u, v), checkpointed; whether they are few; how many are self loops.

    Every shuffle costs the driver a thread and the facts of its tasks, whatever
    little it moves, so rounds over few edges do without any.
    """
    shared_dir(edges.sparkSession)
    seen = Observation()
    out = edges.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("u") == F.col("v")).alias("loops")).checkpoint(eager=True)
    rows, loops = seen.get["rows"], seen.get["loops"]
    if rows <= FEW_EDGES:
        return out.coalesce(1).hint("merge"), True, loops
    return out.hint("merge") if rows > BROADCAST_ROWS else out, False, loops


def _ways(one: tuple[str, str], two: tuple[str, str]) -> Column:
    """Two rows (u, v) of each, by two pairs of expressions: no union, which would go through the rows twice."""
    return F.inline(F.array(*[F.struct(F.expr(u).alias("u"), F.expr(v).alias("v")) for u, v in (one, two)]))


def _all_stars(now: DataFrame) -> bool:
    """Whether every upper node of the edges has one edge, to a node that is nobody's upper one: then the lower ones name the components."""
    ends = now.select(_ways(("u", "1"), ("v", "0"))).toDF("node", "up")
    bent = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR ups = 1 AND least = 0")
    return bent.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of `edges`; a component is named by its smallest node.

    Nulls and self loops name no link: a node that occurs only in self loops is
    a component by itself, an edge with a null end is ignored. Each round is
    two aggregations and two joins and is checkpointed in the shared folder;
    none is made once all edges are stars.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    given, few, loops = _held(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = given.filter("u <> v") if loops else given
    for _ in range(MOST_ROUNDS):
        if _all_stars(now):
            break
        # Spark forgets at a join that its rows lie in one partition
        here = lambda df: df.coalesce(1) if few else df  # noqa: B023, E731
        both = now.select(_ways(("u", "v"), ("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = here(both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = here(large.join(small_least, F.col("u") == F.col("k")))
        small = joined.select(_ways(("v", "m"), ("u", "m"))).filter("u <> v").distinct()
        now, few, _ = _held(small)
    else:
        raise RuntimeError("connected components did not converge")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    linked = members.unionByName(roots)
    if not loops:
        return linked
    rest = given.filter("u = v").join(linked, F.col("u") == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return linked.unionByName(rest)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """A minimum spanning forest of links (a, b, distance): for every bound, the forest's links within it join what all links within it join.

    Each round every tree takes its nearest link to another one (of equal
    distances the smallest pair), and the trees that meet become one, so that
    their number halves at least. Links of a tree to itself are dropped on the
    way.
    """
    links = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = checkpointed(links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("distance")).select("a", "b", "distance", F.col("a").alias("s"), F.col("b").alias("t")))
    parts = []
    for _ in range(MOST_ROUNDS):
        if not left.take(1):
            break
        ends = left.select(F.explode(F.array("s", "t")).alias("tree"), F.struct("distance", "a", "b").alias("link"))
        nearest = checkpointed(ends.groupBy("tree").agg(F.min("link").alias("link")).select("tree", "link.*").join(left.select("a", "b", "s", "t"), ["a", "b"]))
        parts.append(checkpointed(nearest.select("a", "b", "distance").distinct()))
        trees = connected_components(nearest.select("s", "t"), "s", "t")
        one, two = trees.toDF("_s", "_one"), trees.toDF("_t", "_two")
        # every tree with a link has taken one, so each stands in the components
        left = checkpointed(left.join(one, F.col("s") == F.col("_s")).join(two, F.col("t") == F.col("_t")).filter("_one <> _two").select("a", "b", "distance", F.col("_one").alias("s"), F.col("_two").alias("t")))
    else:
        raise RuntimeError("the forest did not converge")
    forest = parts[0] if parts else left.select("a", "b", "distance")
    for part in parts[1:]:
        forest = forest.unionByName(part)
    return forest
