"""Near duplicates of embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within the squared distance 2 - 2c. They are
turned by a fixed random rotation and split into blocks of 8 dimensions; each
block has the part of the squared distance that its dimensions are of all. If
two vectors are near, at least one block is within its part. Each block is
range-joined by itself: its space is cut into orthants of its first
dimensions (as many as the number of vectors asks for); a vector is owned by
its orthant and also goes to every lower one that its budget reaches, which is
when the squares of the coordinates to be flipped sum up to the budget at
most. Inside an orthant, tiles of bounded size are compared by matrix
products; a pair that is in the range of the block and of no earlier one is
verified by its cosine, so the union of the candidates is verified once.
Tiles hold the turned vectors in single precision. Pairs that it can't decide
(the cosine or a block's distance lies within `margin` of its bound) leave the
tile and are decided by the cosine of the given vectors in double precision.

Equal vectors with equal labels are one representative with a count. Beside
undecided pairs only counts of links and spanning links leave a tile. Vectors
that are null, zero, or hold null or non-finite components, and such without a
label, link with nothing, nor do vectors of different lengths. A cosine of just
the bound is a link. Rows that repeat an id share nothing but the id: each has
the links of its own vector, in which equal vectors of other rows count. Rows
without an id link like others. Representatives have numbers of their own; a
component is named by its smallest id at the end, by null if none of its rows
has one (such rows are all kept, as they can't be told apart). An empty table
gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.operators.components import connected_components

from .common import Tables, bounded_batches, table
from .jaccard_join import _Sets

#: Dimensions of a block, vectors that an orthant should own, vectors of a tile's side.
BLOCK, CELL, TILE = 8, 1024, 8192


def margin(dim: int) -> float:
    """Room for rounding of single precision: twice what a sum of `dim` products of unit vectors can be off. What lies inside it is decided in double precision."""
    return max(1e-5, dim * 2.0**-23)


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_240_229).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, dim)) for i in range(0, dim, BLOCK)]


@lru_cache(maxsize=4)
def flips(bits: int) -> list[tuple[int, ...]]:
    return list(chain.from_iterable(combinations(range(bits), n) for n in range(1, bits + 1)))


def assign(reps: DataFrame, limit: float, bits: int) -> DataFrame:
    """Rows (label, dim, block, cell, own, rep, n, vector): each representative in the orthants that own or reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "block", "cell", "own", "rep", "n", "vector"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                dims = np.array(batch.column(1).to_pylist())
                rows: list[list] = [[] for _ in range(5)]
                packed = {}
                for dim in np.unique(dims).tolist():
                    places = np.flatnonzero(dims == dim)
                    x = np.array(batch.column(4).take(pa.array(places)).to_pylist(), np.float64)
                    x /= np.abs(x).max(1, keepdims=True)  # no overflow of squares
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    x = x @ rotation(dim)
                    packed.update(zip(places.tolist(), (v.tobytes() for v in x.astype(np.float32)), strict=True))
                    for b, part in enumerate(blocks(dim)):
                        y = x[:, part]
                        k = min(bits, y.shape[1])
                        code = (y[:, :k] > 0) @ (1 << np.arange(k)) if k else np.zeros(len(y), int)
                        budget = limit * y.shape[1] / dim + margin(dim)
                        targets = [(np.arange(len(y)), code, True)]
                        for f in flips(k):
                            flipped = code ^ sum(1 << i for i in f)
                            reach = np.flatnonzero(((y[:, list(f)] ** 2).sum(1) <= budget) & (flipped < code))
                            targets.append((reach, flipped[reach], False))
                        for who, cells, own in targets:
                            rows[0] += places[who].tolist()
                            rows[1] += [b] * len(who)
                            rows[2] += cells.tolist()
                            rows[3] += [own] * len(who)
                take = pa.array(rows[0], pa.int64())
                vectors = pa.array([packed[i] for i in rows[0]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.bool_()), batch.column(2).take(take), batch.column(3).take(take), vectors], names=names)

    label = reps.schema["label"].dataType.simpleString()
    return reps.select("label", "dim", "rep", "n", "embedding").mapInArrow(run, f"label {label}, dim int, block int, cell int, own boolean, rep long, n long, vector binary")


def tile_links(x: np.ndarray, own: np.ndarray, side: np.ndarray, n: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, _Sets, np.ndarray]:
    """Weighted counts of links and their union among the vectors of a tile, and the undecided pairs (two columns of places)."""
    dim, limit, room = x.shape[1], 2 - 2 * cosine, margin(x.shape[1])
    parts = blocks(dim)
    budgets = np.array([limit * (p.stop - p.start) / dim for p in parts[: block + 1]], np.float32)
    counts, groups, unsure = np.zeros(len(x), np.int64), _Sets(len(x)), [np.zeros((0, 2), np.int64)]
    two = len(np.unique(side)) > 1
    owners = np.flatnonzero(own)
    place = np.arange(len(x))
    low = x[:, parts[block]]
    half = (low**2).sum(1) / 2
    for at in range(0, len(owners), 256):
        i = owners[at : at + 256]
        # in range of the block: 2 x.y >= |x|^2 + |y|^2 - budget
        near = low[i] @ low.T >= half[i][:, None] + (half - (budgets[block] / 2 + np.float32(room)))[None, :]
        r, c = np.nonzero(near)
        ok = ~own[c] | (place[c] > i[r])
        if two:
            ok &= side[c] != side[i[r]]
        r, c = i[r[ok]], c[ok]
        for q in np.array_split(np.arange(len(r)), 1 + len(r) // 20_000):
            a, z = r[q], c[q]
            # how far the pair is beyond the budget of this block and of the earlier ones
            over = np.add.reduceat((x[a] - x[z]) ** 2, [p.start for p in parts], 1)[:, : block + 1] - budgets
            close = np.einsum("ij,ij->i", x[a], x[z]) - np.float32(cosine)
            # what is surely too far apart, or surely found in an earlier block, goes
            kept = (close > -room) & (over[:, -1] <= room) & (over[:, :-1] > -room).all(1)
            a, z, over, close = a[kept], z[kept], over[kept], close[kept]
            sure = (close > room) & (np.abs(over) > room).all(1)
            unsure.append(np.stack((a[~sure], z[~sure]), 1))
            a, z = a[sure], z[sure]
            np.add.at(counts, a, n[z])
            np.add.at(counts, z, n[a])
            for u, v in zip(a.tolist(), z.tolist(), strict=True):
                groups.join(u, v)
    return counts, groups, np.concatenate(unsure)


def tile_results(tiles: DataFrame, cosine: float) -> DataFrame:
    """Rows (rep, links, root) for the representatives with links in a tile, and rows (rep, other) of undecided pairs."""

    def run(tile: pa.Table) -> pa.Table:
        x = np.array([np.frombuffer(v, np.float32) for v in tile.column("vector").to_pylist()])
        rep, n = tile.column("rep").to_numpy(), tile.column("n").to_numpy()
        counts, groups, unsure = tile_links(x, tile.column("own").to_numpy(), tile.column("t").to_numpy(), n, tile.column("block")[0].as_py(), cosine)
        hit = np.flatnonzero(counts)
        roots = np.array([int(rep[groups.find(int(k))]) for k in hit], np.int64)
        none = pa.nulls(len(unsure), pa.int64())
        return pa.table([pa.concat_arrays([pa.array(rep[hit]), pa.array(rep[unsure].min(1, initial=2**63 - 1))]), pa.concat_arrays([pa.array(counts[hit]), none]), pa.concat_arrays([pa.array(roots), none]), pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(rep[unsure].max(1, initial=-1))])], names=["rep", "links", "root", "other"])

    return tiles.groupBy("label", "dim", "block", "cell", "a", "b").applyInArrow(run, "rep long, links long, root long, other long")


def decided(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """Of undecided pairs (rep, other) those whose given vectors have the cosine in double precision, with the counts of both."""

    @F.arrow_udf("boolean")
    def linked(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for u, v in zip(one.to_pylist(), two.to_pylist(), strict=True):
            x, y = np.array(u, np.float64), np.array(v, np.float64)
            x, y = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in (x, y))  # no overflow of squares, and no rounding
            out.append(bool((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= cosine))
        return pa.array(out, pa.bool_())

    known = reps.select("rep", "n", "embedding")
    joined = pairs.join(known.toDF("rep", "n_rep", "e_rep"), "rep").join(known.toDF("other", "n_other", "e_other"), "other")
    return joined.filter(linked(F.col("e_rep"), F.col("e_other"))).select("rep", "other", "n_rep", "n_other")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """Per row: the key as `id_col`, n_links, component_id, kept."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec"), F.col(f"`{vector}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & finite, F.lit(False)))
    same = usable.filter("usable").groupBy("label", "embedding").agg(F.min("vec").alias("smallest"), F.count("*").alias("n")).withColumn("dim", F.size("embedding"))
    # numbers are never null, as ids may be; they hold once they are written
    tables = Tables(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    reps = tables.keep(same.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    most = reps.groupBy("label", "dim").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    bits = max(0, min(BLOCK, math.ceil(math.log2(max(1, most / CELL)))))
    placed = assign(reps, 2 - 2 * cosine, bits)
    cell = ["label", "dim", "block", "cell"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    with_tile = placed.join(sizes, cell).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    spread = with_tile.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = spread.select(*cell, F.least("t", "other").alias("a"), F.greatest("t", "other").alias("b"), "t", "own", "rep", "n", "vector")
    found = tables.keep(tile_results(tiles, cosine), "vector-links")
    # a pair may be undecided in the tiles of several blocks
    late = tables.keep(decided(found.filter("other IS NOT NULL").select("rep", "other").distinct(), reps, cosine), "late-links")

    counted = found.filter("other IS NULL").select("rep", "links").unionByName(late.select("rep", F.col("n_other").alias("links"))).unionByName(late.select(F.col("other").alias("rep"), F.col("n_rep").alias("links")))
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("rep <> root").select("rep", "root").unionByName(late.select("rep", F.col("other").alias("root"))), "rep", "root")
    named = reps.select("rep", "smallest").join(groups, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("smallest").alias("name"))
    known = reps.select(F.col("label").alias("l"), F.col("embedding").alias("e"), "rep", "n", "smallest").join(links, "rep", "left").join(groups.join(named, "component"), F.col("rep") == F.col("node"), "left")
    own = known.select("l", "e", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "smallest").alias("component"))
    out = usable.join(own, F.col("usable") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec").eqNullSafe(component).alias("kept"))


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component c ON e.vec_id = c.node LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a
"""
