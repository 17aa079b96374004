"""Vector code compression: product quantisation whose nearest entries are found by bitmasks.

Vectors become integers (floor of 256 times each component) and are cut into
equal consecutive parts; every part position has a codebook of at most 64
entries, so that a set of entries is one 64-bit mask. The codebooks start as
the parts of the vectors with the smallest ids and are bettered in rounds:
every part goes to its nearest entry (squared distance, ties to the lower
index), then an entry becomes the floor of the mean of its parts.

The nearest entry is found by slice and intersect. Each dimension of a codebook
holds its coordinates in order and, for every prefix of that order, the mask
of the entries in it. An initial radius selects a range of each dimension; the
difference of two prefix masks is the set of entries inside it, and the sets of
all dimensions ANDed are the entries of the cube around the part. Only these
are measured. If the best of them is within the radius it is the nearest
one, as the cube holds the ball; else the distance of the best, or twice the
radius where the cube is empty, is the next radius.

A round is one pass over the vectors. Tasks send sums and counts per entry,
which are as many as codebooks have entries; the codebooks themselves (64 short
vectors a part) are what the driver holds and ships.

Vectors that are null or hold null or non-finite components are left out.
Integers are held in a bound that keeps squared distances inside 64 bits (some
2^29 for usual lengths, so components up to two million are exact). Vectors of
different lengths have codebooks of their own; where a length isn't a multiple
of the number of parts, the first parts are one longer, and parts without
components have only the entry 0. With fewer than 64 vectors the codebooks have
fewer entries. Rows that repeat an id, or have none (they come last), are
vectors like others; among equal ids the smaller vector comes first. An empty
table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, bounded_batches, finite_vector, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts that are measured at once inside a task.
BLOCK_ROWS = 4096
#: A label with this part of all rows or more is joined by a broadcast of its sum; there are at most so many such labels.
HOT_LABELS = 1000


def as_integers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x) as 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    most = math.isqrt((1 << 62) // max(dim, 1)) // 2
    return np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)


def slices(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of equal length; the first ones are one longer where the length isn't a multiple."""
    short, longer = divmod(dim, parts)
    edges = np.cumsum([0] + [short + (p < longer) for p in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


class Codebook:
    """The entries of one part position (at most 64 rows of integers), with prefix masks of every dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, 0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.prefix = np.concatenate((np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, 0)))
        self.whole = np.uint64((1 << len(entries)) - 1)
        # how far entries are from each other says how far a part is from its nearest one; at most 64 x 64 distances
        apart = np.square(entries[:, None] - entries[None]).sum(2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.radius = max(1, math.isqrt(int(np.median(apart.min(1)))) // 2) if len(entries) > 1 else 1

    def inside(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row the mask of the entries that differ by `radius` at most in every dimension."""
        masks = np.full(len(x), self.whole)
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            masks &= self.prefix[high, d] ^ self.prefix[low, d]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry (ties to the lower) and the squared distance."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if not x.shape[1]:
            return index, distance
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(todo):
            masks = self.inside(x[todo], radius)
            held = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(held)
            far = np.square(x[todo[row]] - self.entries[entry]).sum(1)
            best = np.full(len(todo), np.iinfo(np.int64).max)
            np.minimum.at(best, row, far)
            hit = far == best[row]
            # entries of a row come in order, so the first one that is as near is the lowest
            lowest = np.full(len(todo), len(self.entries))
            np.minimum.at(lowest, row[hit], entry[hit])
            some = masks != 0
            done = some & (best <= radius * radius)
            index[todo[done]], distance[todo[done]] = lowest[done], best[done]
            root = np.ceil(np.sqrt(np.where(some, best, 0).astype(np.float64))).astype(np.int64) + 1
            radius, todo = np.where(some, root, radius * 2)[~done], todo[~done]
        return index, distance


@dataclass(frozen=True)
class Codebooks:
    """The codebooks of all part positions of vectors of one length."""

    dim: int
    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components as decimal integers by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(v) for part in self.entries for v in part.reshape(-1).tolist()).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The components that a code stands for."""
        return np.concatenate([part[k] for part, k in zip(self.entries, bytes.fromhex(code), strict=True)]) / SCALE


def assigned(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's part in each codebook."""
    places = slices(x.shape[1], len(books))
    found = [book.nearest(np.ascontiguousarray(x[:, at])) for book, at in zip(books, places, strict=True)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, min(BLOCK_ROWS, (1 << 22) // max(dim, 1)))
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, as_integers(part.column(at), dim)


def sums_of_entries(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (part, entry, n, total): how many parts an entry is nearest to, and their sum by component."""
    entries, dim = books.entries, books.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in entries]
        places = slices(dim, len(own))
        n = [np.zeros(len(e), np.int64) for e in entries]
        totals = [np.zeros(e.shape, np.int64) for e in entries]
        for _, x in _blocks(batches, 0, dim):
            index, _ = assigned(x, own)
            for p, at in enumerate(places):
                n[p] += np.bincount(index[:, p], minlength=len(n[p]))
                np.add.at(totals[p], index[:, p], x[:, at])
        rows = [(p, k, int(n[p][k]), totals[p][k].tolist()) for p in range(len(own)) for k in np.flatnonzero(n[p]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "total"])

    partial = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, total array<long>")
    width = -(-dim // len(entries))
    sums = [F.coalesce(F.sum(F.get("total", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).select("part", "entry", "n", F.array(*[F.col(f"s{i}") for i in range(width)]).alias("total"))


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (vec, vector) of one length; `entries` is 64 at most."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    first = vectors.orderBy(F.asc_nulls_last("vec"), "vector").limit(entries).select("vector").toArrow()
    start = as_integers(first.column(0).combine_chunks(), dim)
    places = slices(dim, parts)
    books = Codebooks(dim, [start[:, at].copy() for at in places])
    for _ in range(rounds if dim else 0):
        found = sums_of_entries(vectors, books).collect()  # a row for each entry at most
        better = [e.copy() for e in books.entries]
        for r in found:
            width = better[r.part].shape[1]
            better[r.part][r.entry] = [s // r.n for s in r.total[:width]]
        books = Codebooks(dim, better)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec, vector, label) of one length as (vec, label, code, error)."""
    entries, dim = books.entries, books.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in entries]
        for part, x in _blocks(batches, 2, dim):
            index, distance = assigned(x, own)
            packed = index.astype(np.uint8)
            codes = [row.tobytes().hex() for row in packed]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(distance.sum(1))], names=["vec", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec", "label", "vector").mapInArrow(run, f"vec {kinds['vec']}, label {kinds['label']}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Rows with label_error, the sum of error over equal labels (nulls together).

    Labels that hold many rows are at most HOT_LABELS, and their sums are
    broadcast; the rows of all others are joined by label.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    total = coded.count()
    hot = sums.filter(F.col("_n") * HOT_LABELS >= total).select(F.col("label").alias("_h"), F.col("label_error").alias("_hot"), F.lit(True).alias("_is_hot"))
    rows = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_h")), "left").drop("_h")
    cool = sums.select(F.col("label").alias("_l"), F.col("label_error").alias("_cool"))
    rest = rows.filter("_is_hot IS NULL").join(cool, F.col("label").eqNullSafe(F.col("_l"))).select(*coded.columns, F.col("_cool").alias("label_error"))
    return rows.filter("_is_hot").select(*coded.columns, F.col("_hot").alias("label_error")).unionByName(rest)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: the id as `id_col`, code, error, label_error, codebooks_sha256."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label")).filter(finite_vector(F.col("vector")))
    spark = rows.sparkSession
    tables = Tables(spark)
    bounded_batches(spark)
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    coded = None
    for dim in lengths:
        own = rows.filter(F.size("vector") == dim)
        books = train(own, dim, parts, entries, rounds)
        one = encode(own, books).withColumn("codebooks_sha256", F.lit(books.sha256()))
        coded = one if coded is None else coded.unionByName(one)
    if coded is None:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        coded = spark.createDataFrame([], f"vec {kinds['vec']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")
    done = with_label_errors(tables.keep(coded, "vector-codes"))
    return done.select(F.col("vec").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _round(k: int, more: bool) -> str:
    """SQL of one assignment (`near`) of all parts to the codebooks `book{k}`, and of the bettered codebooks."""
    near = f"""
near{k} AS (
  SELECT vec_id, p, min(k) AS k, min(d) AS d FROM (
    SELECT vec_id, p, k, d, min(d) OVER (PARTITION BY vec_id, p) AS least FROM (
      SELECT x.vec_id, x.p, b.k, list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i])))::BIGINT AS d
      FROM part x JOIN book{k} b ON x.p = b.p)) WHERE d = least GROUP BY vec_id, p)"""
    better = f""",
book{k + 1} AS (
  SELECT b.p, b.k, CASE WHEN s.n IS NULL THEN b.c ELSE s.c END AS c FROM book{k} b LEFT JOIN (
    SELECT p, k, max(n) AS n, list(m ORDER BY i) AS c FROM (
      SELECT a.p, a.k, i, count(*) AS n, ((sum(x.c[i]) - (((sum(x.c[i]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS m
      FROM near{k} a JOIN part x ON a.vec_id = x.vec_id AND a.p = x.p, (SELECT unnest(range(1, 5)) AS i) GROUP BY a.p, a.k, i) GROUP BY p, k) s
  ON b.p = s.p AND b.k = s.k)"""
    return near + (better if more else "")


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, e[4 * p + 1 : 4 * p + 4] AS c FROM v, (SELECT unnest(range(16)) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT 64),
book0 AS (SELECT p, k, c FROM part JOIN first USING (vec_id)),{_round(0, True)},{_round(1, True)},{_round(2, False)},
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books
"""
