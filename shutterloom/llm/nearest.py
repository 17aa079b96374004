"""Nearest vectors by largest inner product: multi-index hashing of learned binary codes.

Model. Vectors get one more component that makes all their lengths equal to the
longest one, so that the largest inner product is the smallest angle; queries
are scaled to length 1 and get a zero. On a bounded sample a centre, principal
axes and rotations are learned (each rotation is turned, step by step, towards
the corners of the cube, so that signs lose least); the signs along the rotated
axes, from as many rotations as it takes, are a code of 128 bits.

Index. Equal vectors are one entry, with the smallest ids of its rows. The
code of an entry is split into four substrings, and the entry stands in the
list of each of them. Lists are grouped into blocks by a prefix of the
substring whose length follows the number of entries, and blocks beyond a
tile's size are split, so that no task holds more than two tiles.

Search. If two codes differ in at most r bits, some substring differs in at most
its share of r (the shares sum up to r - 3). A query therefore goes to the
blocks whose prefixes are within the share, probes the substrings there that
are, and gets every code within r bits; a pair is taken at the first substring
that finds it, reranked by the inner product of the given vectors in double
precision, and the best of each query leave the tile. A query that has met too
few entries goes on with a larger radius, at last with 128 bits, which is
everything. The first radius is measured: the nearest entries of a few queries
are found by brute force over the whole index, and the radius is what it takes
to reach the wanted part of them.

Rows. Null, zero and non-finite vectors take no part, nor do vectors of other
lengths in a query's search (each length has an index of its own). Each row
whose id is asked for is a query; its candidates are all other rows, those that
repeat its id or vector included. Rows without an id are no queries; as
candidates they come after all others of the same score. An empty table, or one
without queries, gives no rows; other columns don't matter, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, bounded_batches, finite_vector, table

#: Bits of a code, and substrings that it is split into.
BITS, PIECES = 128, 4
WIDTH = BITS // PIECES
#: Entries and queries of a tile.
TILE, QUERY_TILE = 32768, 4096
#: Vectors (at most so many, and bytes of them) that the model is fitted on; queries whose true neighbours set the radius; part of these to be reached.
SAMPLE, SAMPLE_BYTES, TRIALS, REACH = 16384, 64 << 20, 64, 0.97
#: Steps of a rotation towards the corners of the cube.
STEPS = 20


@dataclass(frozen=True)
class Model:
    """What turns vectors of one length into codes; `scale` keeps squares in range, `longest` is the largest length."""

    scale: float
    longest: float
    centre: np.ndarray
    turns: np.ndarray  # (components + 1) x BITS

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes of rows of doubles as (rows, PIECES) 32-bit integers."""
        x = x / self.scale
        squares = (x * x).sum(1)
        if query:
            wide = np.column_stack((x / np.sqrt(squares)[:, None], np.zeros(len(x))))
        else:
            rest = np.sqrt(np.maximum(0.0, 1.0 - squares / self.longest**2))
            wide = np.column_stack((x / self.longest, rest))
        return np.packbits((wide - self.centre) @ self.turns > 0, axis=1).view(np.uint32)


def fit(sample: np.ndarray, scale: float, longest: float) -> Model:
    """A model from a bounded sample of vectors (rows of doubles)."""
    x = sample / scale
    wide = np.column_stack((x / longest, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1) / longest**2))))
    centre = wide.mean(0)
    y = wide - centre
    axes = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :BITS]
    rng = np.random.default_rng(1_797_693)
    turns: list[np.ndarray] = []
    while sum(t.shape[1] for t in turns) < BITS:
        low = y @ axes
        turn = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(STEPS):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        turns.append(axes @ turn)
    return Model(scale, longest, centre, np.concatenate(turns, 1)[:, :BITS])


def shares(radius: int) -> list[int]:
    """What each substring may differ by so that any two codes within `radius` bits have one that does; -1 for none."""
    total = radius - PIECES + 1
    return [max(-1, total // PIECES + (p < total % PIECES)) for p in range(PIECES)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def coded(rows: DataFrame, model: Model, query: bool) -> DataFrame:
    """`rows` with the substrings of the codes of `vector`, c0, c1, ..., as longs."""
    at = rows.columns.index("vector")
    names = [*rows.columns, *[f"c{p}" for p in range(PIECES)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.codes(_matrix(batch.column(at)), query) if batch.num_rows else np.zeros((0, PIECES), np.uint32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(codes[:, p].astype(np.int64)) for p in range(PIECES)]], names=names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*kinds, *[f"c{p} long" for p in range(PIECES)]]))


def _of_piece(values: list, piece: Column) -> Column:
    return F.element_at(F.array(*values), piece + 1)


def placed(entries: DataFrame, prefix: int) -> DataFrame:
    """Each entry in the block of each of its substrings: piece and block are added."""
    each = entries.withColumn("piece", F.explode(F.array(*[F.lit(p) for p in range(PIECES)])))
    value = _of_piece([F.col(f"c{p}") for p in range(PIECES)], F.col("piece"))
    return each.withColumn("block", F.shiftright(value, WIDTH - prefix))


def probes(queries: DataFrame, prefix: int, radius: int) -> DataFrame:
    """Each query at every block that its substrings' shares of the radius reach: piece and block are added."""
    each = queries.withColumn("piece", F.explode(F.array(*[F.lit(p) for p in range(PIECES)])))
    value = _of_piece([F.col(f"c{p}") for p in range(PIECES)], F.col("piece"))
    share = _of_piece([F.lit(s) for s in shares(radius)], F.col("piece"))
    # the prefixes are at most 2^prefix, which is a tile's part of the entries
    all_blocks = F.sequence(F.lit(0).cast("long"), F.lit((1 << prefix) - 1).cast("long"))
    near = F.filter(all_blocks, lambda b: F.bit_count(b.bitwiseXOR(F.shiftright(value, WIDTH - prefix))) <= share)
    return each.withColumn("block", F.explode(near))


def tile_best(q_codes: np.ndarray, q_vectors: np.ndarray, codes: np.ndarray, vectors: np.ndarray, piece: int, radius: int, most: int, alone: np.ndarray, q_entry: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best entries of each query among those that substring `piece` is the first to find.

    Gives places of queries, places of entries, scores, and how many entries
    each query met. `alone` tells entries of one row, which a query that is
    this row (`q_entry`) doesn't meet.
    """
    share = shares(radius)
    order = np.argsort(codes[:, piece], kind="stable")
    values, starts = np.unique(codes[order, piece], return_index=True)
    ends = np.append(starts[1:], len(order))
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    met = np.zeros(len(q_codes), np.int64)
    for i, own in enumerate(q_codes):
        near = np.bitwise_count(values ^ own[piece]) <= share[piece]
        hit = order[np.repeat(near, ends - starts)]
        if not len(hit):
            continue
        apart = np.bitwise_count(codes[hit] ^ own)
        fits = apart.sum(1, dtype=np.int64) <= radius
        for p in range(piece):
            fits &= apart[:, p] > share[p]
        fits &= ~(alone[hit] & (number[hit] == q_entry[i]))
        hit = hit[fits]
        met[i] = len(hit)
        if len(hit):
            score = (vectors[hit] * q_vectors[i]).sum(1)
            if len(hit) > most:
                # those of equal scores with the last one that counts stay, the ids decide between them later
                least = np.partition(score, -most)[-most]
                keep = score >= least
                hit, score = hit[keep], score[keep]
            out[0].append(np.full(len(hit), i))
            out[1].append(hit)
            out[2].append(score)
    a, b, s = (np.concatenate(x) for x in out)
    return a, b, s, met


def searched(queries: DataFrame, index: DataFrame, prefix: int, radius: int, most: int) -> DataFrame:
    """Rows (query, entry, score, met) of queries (num, entry, vector, c..) in an index (num, vector, alone, smallest, c..).

    Of each tile a query's best entries, and one row without entry that says how many entries it met.
    """
    at = ["piece", "block"]
    entries, asked = placed(index, prefix), probes(queries, prefix, radius)
    sizes = entries.groupBy(*at).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    q_sizes = asked.groupBy(*at).agg(F.ceil(F.count("*") / QUERY_TILE).cast("int").alias("q_tiles"))
    # at most PIECES * 2^(WIDTH / 2) rows of numbers, some 8 MB
    both = F.broadcast(sizes.join(q_sizes, at))
    deal = lambda n: F.pmod(F.xxhash64("num"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    codes = [f"c{p}" for p in range(PIECES)]
    columns = [*at, "tile", "q_tile", "num", "entry", "alone", "smallest", "vector", *codes]
    one = entries.join(both, at).withColumns({"tile": deal("tiles"), "q_tile": span("q_tiles"), "entry": F.lit(None).cast("long")})
    two = asked.join(both, at).withColumns({"tile": span("tiles"), "q_tile": deal("q_tiles"), "alone": F.lit(None).cast("boolean"), "smallest": F.lit(None).cast("long")})

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "entry", "score", "smallest", "met"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())], names=names)
        left, right = left.combine_chunks(), right.combine_chunks()
        number = lambda t, c: t.column(c).to_numpy()
        packed = lambda t: np.stack([number(t, c) for c in codes], 1).astype(np.uint32)
        x, y = (_matrix(t.column("vector").chunk(0)) for t in (left, right))
        single = np.array(left.column("alone").to_pylist(), bool)
        a, b, score, met = tile_best(packed(right), y, packed(left), x, key[0].as_py(), radius, most, single, number(right, "entry"), number(left, "num"))
        smallest, q = left.column("smallest").chunk(0), number(right, "num")
        who = np.flatnonzero(met)
        none = pa.nulls(len(who), pa.int64())
        return pa.table([pa.array(np.concatenate((q[a], q[who]))), pa.concat_arrays([pa.array(number(left, "num")[b]), none]), pa.concat_arrays([pa.array(score), pa.nulls(len(who), pa.float64())]), pa.concat_arrays([smallest.take(pa.array(b)), none]), pa.concat_arrays([pa.nulls(len(b), pa.int64()), pa.array(met[who])])], names=names)

    group = [*at, "tile", "q_tile"]
    return one.select(columns).groupBy(*group).cogroup(two.select(columns).groupBy(*group)).applyInArrow(run, "query long, entry long, score double, smallest long, met long")


def first_radius(trials: pa.Table, index: DataFrame, model: Model, most: int, reach: float) -> int:
    """The radius that holds the part `reach` of the `most` nearest entries of a few queries (num, entry, vector), found by brute force over the whole index."""
    x = _matrix(trials.column("vector").combine_chunks())
    own = trials.column("entry").to_numpy()
    q_codes = model.codes(x, True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, apart = np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64)
        for batch in batches:
            y = _matrix(batch.column(1))
            if not len(y):
                continue
            codes = np.stack([batch.column(2 + p).to_numpy() for p in range(PIECES)], 1).astype(np.uint32)
            s = np.where(own[:, None] == batch.column(0).to_numpy()[None], -np.inf, x @ y.T)
            d = np.bitwise_count(q_codes[:, None] ^ codes[None]).sum(2, dtype=np.int64)
            score, apart = np.concatenate((score, s), 1), np.concatenate((apart, d), 1)
            kept = np.argsort(-score, 1, kind="stable")[:, :most]
            score, apart = np.take_along_axis(score, kept, 1), np.take_along_axis(apart, kept, 1)
        n = score.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), n)), pa.array(score.reshape(-1)), pa.array(apart.reshape(-1))], names=["trial", "score", "apart"])

    found = index.select("num", "vector", *[f"c{p}" for p in range(PIECES)]).mapInArrow(best, "trial long, score double, apart long").filter(F.col("score") > float("-inf"))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "apart"))).filter(F.col("r") <= most)
    apart = sorted(r.apart for r in ranked.select("apart").collect())  # TRIALS * most numbers at most
    return apart[min(len(apart) - 1, int(np.ceil(reach * len(apart))))] if apart else BITS


def _one_length(rows: DataFrame, tables: Tables, dim: int, asked: Column, most: int, reach: float) -> DataFrame | None:
    """Rows (query_id, rank, vec, score) of the vectors (vec, vector, row) of one length; None without queries."""
    spark = rows.sparkSession
    # equal vectors are one entry, which keeps its smallest ids: as many as may be among the nearest, and the query's own
    first = Window.partitionBy("vector").orderBy(F.asc_nulls_last("vec"), "row")
    ids = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most + 1).groupBy("vector").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("vec", F.lit(2**63 - 1)).alias("place"), "vec", "row"))).alias("ids"))
    entries = tables.keep(ids.withColumn("num", F.monotonically_increasing_id()), "entries")
    keyed = rows.filter(asked).select("row", F.col("vec").alias("query_id"), "vector")
    queries = tables.keep(keyed.join(entries.select("vector", F.col("num").alias("entry")), "vector").withColumn("num", F.col("row")), "queries")

    scale = float(entries.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()[0])
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x.cast("double") / scale) * (x.cast("double") / scale))
    longest = float(entries.agg(F.sqrt(F.max(square))).first()[0])
    n = entries.count()
    size = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * (dim + 1))))
    # those with the smallest hashes; only about twice as many leave their tasks
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 40))
    below = entries.withColumn("place", place).filter(F.col("place") <= min(1 << 40, (1 << 40) * 2 * size // max(1, n)))
    drawn = below.orderBy("place", "num").limit(size).select("vector").toArrow()
    model = fit(_matrix(drawn.column(0).combine_chunks()), scale, longest)

    facts = entries.select("num", "vector", (F.size("ids") == 1).alias("alone"), F.get("ids", F.lit(0))["vec"].alias("smallest"))
    index = tables.keep(coded(facts, model, False), "index")
    pending = tables.keep(coded(queries.select("num", "entry", "vector"), model, True), "pending-0")
    trials = pending.orderBy(F.xxhash64("num"), "num").limit(TRIALS).select("num", "entry", "vector").toArrow()
    if not trials.num_rows:
        return None
    radius = first_radius(trials, index, model, most, reach)
    # from a tile's number of entries on, a block holds about as many
    prefix = max(0, min(WIDTH // 2, (n // TILE).bit_length()))

    # an own entry of one row is not met, so as many entries as rows are wanted hold these rows
    found, turn, names = None, 0, []
    while True:
        got = tables.keep(searched(pending, index, prefix, radius, most + 1), "found")
        if radius >= BITS:
            enough = pending.select(F.col("num").alias("query"))
        else:
            enough = got.groupBy("query").agg(F.sum("met").alias("met")).filter(F.col("met") >= most).select("query")
        names.append(f"best-{turn}")
        best = tables.keep(got.filter("entry IS NOT NULL").join(enough, "query", "left_semi").select("query", "entry", "score", "smallest"), names[-1])
        found = best if found is None else found.unionByName(best)
        left = tables.keep(pending.join(enough, F.col("num") == F.col("query"), "left_anti"), f"pending-{turn + 1}")
        tables.drop("found", f"pending-{turn}")
        pending, turn = left, turn + 1
        if not pending.take(1):
            break
        radius = min(BITS, radius + BITS // 8) if turn < 3 else BITS

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("smallest"), "entry")
    kept = found.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= most + 1)
    rows_of = kept.join(entries.select(F.col("num").alias("entry"), "ids"), "entry").select("query", "score", F.explode("ids").alias("i")).filter("i.row <> query")
    rank = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("i.vec"), "i.row")
    ranked = rows_of.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most)
    out = ranked.join(queries.select(F.col("num").alias("query"), "query_id"), "query").select("query_id", "rank", F.col("i.vec").alias("vec"), "score")
    done = tables.keep(out, f"nearest-{dim}")
    tables.drop("entries", "queries", "index", f"pending-{turn}", *names)
    return done


def nearest(vectors: DataFrame, asked: Column, most: int = 20, id_col: str = "vec_id", vector: str = "embedding", reach: float = REACH) -> DataFrame:
    """Per query row and neighbour: query_id, rank, the neighbour's id as `id_col`, score.

    `asked` is a condition on the column `vec` (the id as a long) that tells
    the queries. Each gets `most` rows, or as many as it has candidates.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec"), F.col(f"`{vector}`").alias("vector"))
    usable = rows.filter(finite_vector(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    spark = rows.sparkSession
    tables = Tables(spark)
    bounded_batches(spark)
    # rows have numbers of their own; they hold once they are written
    numbered = tables.keep(usable.withColumn("row", F.monotonically_increasing_id()), "rows")
    out = None
    for dim in sorted(r[0] for r in numbered.select(F.size("vector")).distinct().collect()):
        one = _one_length(numbered.filter(F.size("vector") == dim), tables, dim, F.coalesce(asked, F.lit(False)), most, reach)
        if one is not None:
            out = one if out is None else out.unionByName(one)
    tables.drop("rows")
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, vec long, score double")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec") % 20 == 0, 20)
