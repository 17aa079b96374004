"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.scratch import shared_dir

#: A-Z to lower case; everything ASCII that is neither a letter nor a digit to a space.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
#: A-Z to lower case, nothing else.
LOWER_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: A-Z to lower case; ASCII white space (what `bytes.split` parts words at) to a space.
SPACED_TABLE = bytes(0x20 if 0x09 <= c <= 0x0D else x for c, x in enumerate(LOWER_TABLE))

#: Bytes of text that an operator handles at once inside a task.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Intermediate Parquet tables in the shared folder, which can be deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write `df` (with options of the writer) and read it again."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that goes to a Python worker. Texts may be long, and batches of Spark's default
#: of 10 000 rows take hundreds of megabytes in the JVM and the workers of an executor.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's rows per Arrow batch to BATCH_ROWS where Spark's default stands; a value of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


#: Longs of bits of a sieve.
SIEVE_WORDS = 1 << 18


def sieved(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows whose 64-bit `key` may be a `wanted_key`, so that other rows aren't shuffled to a join.

    Keys set bits of SIEVE_WORDS longs, which bounds what is broadcast; a full
    sieve lets all rows through and changes no result.
    """
    place = lambda c: F.pmod(c, F.lit(64 * SIEVE_WORDS))
    marked = wanted.select(place(wanted_key).alias("_p")).select(F.shiftright("_p", 6).alias("_word"), F.expr("shiftleft(1L, cast(_p % 64 AS int))").alias("_bit"))
    bits = marked.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = rows.withColumn("_p", place(key))
    kept = own.join(F.broadcast(bits), (F.shiftright("_p", 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, cast(_p % 64 AS int))")) != 0), "left_semi")
    return kept.drop("_p")


def finite_vector(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def by_bytes(items: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of `items` with about `most` bytes each, one item at least."""
    start, held = 0, 0
    for i, x in enumerate(items):
        if held and held + len(x) > most:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(items):
        yield start, len(items)


#: Fixed random values of bytes and an odd factor, for hashes of words.
_VALUES = np.random.default_rng(1_618_033).integers(1, 2**64, 256, np.uint64)
_VALUES[0x20] = 0
_FACTOR = 0x9FB21C651E98DF25 | 2
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: Bytes that are hashed at once; a longer word is hashed by itself.
_SPAN = 1 << 17


@lru_cache(maxsize=2)
def _powers(factor: int) -> np.ndarray:
    out = np.full(_SPAN + 1, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of texts: `hashes` in order, `begins` (for each text and the end, the number of words before it), and their bytes."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.joined = joined = b" ".join(texts).translate(table) + b" "
        whole = np.frombuffer(joined, np.uint8)
        up, down = _powers(_FACTOR), _powers(_INVERSE)
        hashes, starts, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(whole):
            stop = joined.rfind(b" ", at, at + _SPAN) + 1
            if stop <= at:  # a word longer than a span
                stop = joined.index(b" ", at) + 1
                hashes.append(np.array([xxhash.xxh3_64_intdigest(joined[at : stop - 1])], np.uint64))
                starts.append(np.array([at]))
                ends.append(np.array([stop - 1]))
                at = stop
                continue
            b = whole[at:stop]
            edges = np.flatnonzero(np.diff(b != 0x20, prepend=False))
            start, end = edges[::2], edges[1::2]
            total = np.cumsum(_VALUES[b] * up[: len(b)])
            before = np.where(start > 0, total[start - 1], np.uint64(0))
            hashes.append(_mixed((total[end - 1] - before) * down[start]))
            starts.append(start + at)
            ends.append(end + at)
            at = stop
        self.hashes, self.starts, self.ends = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(lengths + 1))))

    def __getitem__(self, i: int) -> bytes:
        return self.joined[self.starts[i] : self.ends[i]]


def hashed_words(texts: list[bytes], table: bytes = SPACED_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and for each text and the end the number of words before it.

    `table` translates bytes first; it makes a space of what stands between
    words. A word's hash is a polynomial in its bytes' values, mixed, so that
    all words are hashed by differences of one running sum.
    """
    words = Words(texts, table)
    return words.hashes, words.begins


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array."""
    return sorted_values[np.diff(sorted_values, prepend=~sorted_values[:1]) != 0] if len(sorted_values) > 1 else sorted_values


def one_thread() -> None:
    """A task has one core: the tokenizers library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def tokenizer_path(name: str) -> str:
    """A file's place: a path as given, or the name of a public tokenizer on this machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """What a task has worked out for byte strings: a younger and an older generation of at most `most` entries each.

    Strings longer than `longest` are forgotten at the next `trim`, so that the
    bytes held are bounded too.
    """

    def __init__(self, most: int, longest: int):
        self.most, self.longest = most, longest
        self.young: dict[bytes, object] = {}
        self.older: dict[bytes, object] = {}
        self.long: list[bytes] = []

    def missing(self, keys: list[bytes]) -> list[bytes]:
        """The distinct keys that aren't known; afterwards those that are stand in the younger generation."""
        lacking = set(keys).difference(self.young)
        if self.older and lacking:
            kept = [k for k in lacking if k in self.older]
            self.young.update((k, self.older[k]) for k in kept)
            lacking.difference_update(kept)
        self.long += [k for k in lacking if len(k) > self.longest]
        return list(lacking)

    def clear(self) -> None:
        """Forgets all; workers live on after a task."""
        self.young, self.older, self.long = {}, {}, []

    def trim(self) -> None:
        """Keeps the bounds; call it between texts."""
        for k in self.long:
            self.young.pop(k, None)
        self.long.clear()
        if len(self.young) > self.most:
            self.older, self.young = self.young, {}
