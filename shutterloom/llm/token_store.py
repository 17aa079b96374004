"""Token ids on disk as wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents (ascending id), an end id
after each. Its file has the shard's sorted alphabet, the places of the
documents, and a bit plane for each bit of an alphabet position, highest
first; below each plane the ids are stably parted by that bit. Planes are
stored in blocks, each compressed by itself and listed with the ones before
it (the rank directory), so that reading a token, counting an id or finding
its n-th place opens a few blocks of one file only.

Spark writes the files as binary rows of a Parquet folder (`write`): task
commits, retries and any store that Spark knows then work as for other tables.

Documents with null or empty text hold the end id only. Rows with equal ids
keep their place by the text's hash. A null id sorts first. An empty table gives
an empty folder of shards; other columns of the table don't matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterloom.scratch import shared_dir

from . import bpe
from .common import as_bytes, bounded_batches, by_bytes, table

#: A shard ends with the document that fills it; longer documents have a shard of their own.
SHARD_IDS = 1 << 19
#: Bits of a block of a plane (a multiple of 8).
BLOCK_BITS = 1 << 16

_HEAD = struct.Struct("<4sIIIII")  # magic, version, ids, alphabet, documents, planes
_MAGIC = b"WVM1"


def build(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of one shard. `ends`: for each document, the ids up to its end."""
    # positions in the alphabet; ids are small, so a table of flags is faster than a sort
    flags = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    flags[ids] = True
    alphabet = np.flatnonzero(flags).astype("<u4")
    place = np.cumsum(flags, dtype=np.int64) - 1
    now = place[ids].astype(np.uint16 if len(alphabet) <= 65536 else np.uint32)
    planes = max(1, int(len(alphabet) - 1).bit_length())
    packer = zstandard.ZstdCompressor(level=1)
    listing, blocks = [], []
    for p in range(planes - 1, -1, -1):
        mask = (now & (1 << p)) != 0
        packed = np.packbits(mask)
        ones = 0
        for at in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[at : at + BLOCK_BITS // 8]
            block = packer.compress(raw.tobytes())
            listing.append((ones, len(block)))
            blocks.append(block)
            ones += int(np.bitwise_count(raw).sum())
        now = np.concatenate((np.compress(~mask, now), np.compress(mask, now)))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    directory = packer.compress(np.array(listing, "<u4").tobytes() + alphabet.tobytes() + np.asarray(ends, "<u4").tobytes() + docs.tobytes() + known.tobytes())
    head = _HEAD.pack(_MAGIC, len(directory), len(ids), len(alphabet), len(doc_ids), planes)
    return head + directory + b"".join(blocks)


class Shard:
    """A shard's file: access, rank and select by a few blocks; `tokens()` for all ids at once."""

    def __init__(self, payload: bytes):
        magic, size, self.n, alphabet, docs, self.planes = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.reader = zstandard.ZstdDecompressor()
        raw = self.reader.decompress(payload[_HEAD.size : _HEAD.size + size])
        self.per_plane = -(-self.n // BLOCK_BITS)
        cut = 8 * self.per_plane * self.planes
        listing = np.frombuffer(raw[:cut], "<u4").reshape(self.planes, self.per_plane, 2)
        self.before, sizes = listing[:, :, 0].astype(np.int64), listing[:, :, 1].astype(np.int64)
        self.alphabet = np.frombuffer(raw, "<u4", alphabet, cut)
        cut += 4 * alphabet
        self.ends = np.frombuffer(raw, "<u4", docs, cut).astype(np.int64)
        cut += 4 * docs
        self.doc_ids = np.frombuffer(raw, "<i8", docs, cut)
        self.doc_known = np.frombuffer(raw, np.uint8, docs, cut + 8 * docs).astype(bool)
        starts = _HEAD.size + size + np.concatenate(([0], np.cumsum(sizes.reshape(-1))))
        self.starts, self.payload, self.cache = starts, payload, {}
        self.zeros = [self.n - self.rank1(p, self.n) for p in range(self.planes)]

    def block(self, plane: int, k: int) -> np.ndarray:
        key = plane * self.per_plane + k
        if key not in self.cache:
            if len(self.cache) > 4 * self.planes:
                self.cache.clear()
            self.cache[key] = np.unpackbits(np.frombuffer(self.reader.decompress(self.payload[self.starts[key] : self.starts[key + 1]]), np.uint8))
        return self.cache[key]

    def rank1(self, plane: int, i: int) -> int:
        """Ones of a plane before place `i`."""
        if i <= 0 or not self.n:
            return 0
        k = min(i // BLOCK_BITS, self.per_plane - 1)
        return int(self.before[plane, k]) + int(self.block(plane, k)[: i - k * BLOCK_BITS].sum())

    def select(self, plane: int, bit: int, j: int) -> int:
        """Place of the `j`-th (from 0) `bit` of a plane."""
        ones = self.before[plane]
        had = ones if bit else np.arange(self.per_plane) * BLOCK_BITS - ones
        k = int(np.searchsorted(had, j, side="right")) - 1
        inside = np.flatnonzero(self.block(plane, k)[: self.n - k * BLOCK_BITS] == bit)
        return k * BLOCK_BITS + int(inside[j - int(had[k])])

    def access(self, i: int) -> int:
        """The id at place `i`."""
        code = 0
        for p in range(self.planes):
            bit = int(self.block(p, i // BLOCK_BITS)[i % BLOCK_BITS])
            one = self.rank1(p, i)
            i = self.zeros[p] + one if bit else i - one
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, i: int, k: int) -> tuple[int, int, int]:
        code = int(np.searchsorted(self.alphabet, token))
        if code >= len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0, -1
        for p in range(self.planes):
            one_i, one_k = self.rank1(p, i), self.rank1(p, k)
            i, k = (self.zeros[p] + one_i, self.zeros[p] + one_k) if code >> (self.planes - 1 - p) & 1 else (i - one_i, k - one_k)
        return i, k, code

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often `token` stands in places `start` to `end`."""
        i, k, _ = self._range(token, start, self.n if end is None else end)
        return k - i

    def find(self, token: int, j: int) -> int | None:
        """Place of the `j`-th (from 0) `token`; None if there are fewer."""
        i, k, code = self._range(token, 0, self.n)
        if j >= k - i:
            return None
        at = i + j
        for p in range(self.planes - 1, -1, -1):
            bit = code >> (self.planes - 1 - p) & 1
            at = self.select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order, plane by plane from the last."""
        now = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self.block(p, k) for k in range(self.per_plane)])[: self.n].view(bool) if self.n else np.zeros(0, bool)
            zeros = self.zeros[p]
            up = np.empty_like(now)
            up[np.flatnonzero(~bits)] = now[:zeros]
            up[np.flatnonzero(bits)] = now[zeros:] | (1 << (self.planes - 1 - p))
            now = up
        return self.alphabet[now]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode the texts and write shard files to the folder `path`: rows (part, shard, n_ids, first_doc, payload)."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = bpe.codec(tokenizer), TaskContext.get().partitionId()
        tail, held, ends, ids, shard = np.array([end_id], "<u4").tobytes(), [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal shard
            payload = build(np.frombuffer(b"".join(held), "<u4"), np.array(ends), ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([ends[-1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([payload], pa.binary())], names=["part", "shard", "n_ids", "first_doc", "payload"])
            shard += 1
            held.clear(), ends.clear(), ids.clear()
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for i, k in by_bytes(texts, bpe.PART_BYTES):
                for key, packed in zip(keys[i:k], own.encode_stream(texts[i:k]), strict=True):
                    held.append(packed + tail)
                    ends.append((ends[-1] if ends else 0) + len(packed) // 4 + 1)
                    ids.append(key)
                    if ends[-1] >= SHARD_IDS:
                        yield close()
        own.known.clear()
        if ids:
            yield close()

    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc", F.xxhash64("text")).sortWithinPartitions("doc", F.xxhash64("text"))
    ordered.mapInArrow(shards, "part int, shard int, n_ids long, first_doc long, payload binary").write.option("compression", "uncompressed").parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """Rows (p, s, start): the ids before each shard, summed over one row per file (not per document)."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as the writing job had tasks
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard")
    placed = files.select("part", "shard", "n_ids").withColumn("shard_start", F.sum("n_ids").over(inside) - F.col("n_ids")).join(offsets, "part")
    return placed.select(F.col("part").alias("p"), F.col("shard").alias("s"), (F.col("part_start") + F.col("shard_start")).alias("start"))


def documents(files: DataFrame, kind: str, of_shard) -> DataFrame:
    """The documents of shard files: doc_id, start (ids of all documents before it), and the column `value`.

    `of_shard` gives the column's Arrow values, of type `kind`, from a shard's ids and its documents' ends.
    Only its result is shuffled, to meet the starts of the shards.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(payload)
                ends = np.concatenate(([0], shard.ends))
                keys = pa.array(shard.doc_ids, pa.int64(), mask=~shard.doc_known)
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), keys, pa.array(ends[:-1]), pa.array(np.diff(ends)), of_shard(shard.tokens(), ends)], names=["part", "shard", "doc_id", "begin", "n_tokens", "value"])

    out = files.select("part", "shard", "payload").mapInArrow(rows, f"part int, shard int, doc_id long, begin long, n_tokens long, value {kind}")
    return out.join(shard_starts(files), (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select("doc_id", (F.col("begin") + F.col("start")).alias("start"), "n_tokens", "value")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder of shards: doc_id, start, n_tokens, ids."""
    lists = lambda tokens, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view("<i4")))
    return documents(spark.read.parquet(path), "array<int>", lists).withColumnRenamed("value", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and the crc32 of its ids, from the files in `path`; no ids leave the task that reads them."""

    def crc32(tokens: np.ndarray, ends: np.ndarray) -> pa.Array:
        packed = memoryview(tokens.astype("<u4", copy=False).tobytes())
        return pa.array([zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.int64())

    return documents(spark.read.parquet(path), "long", crc32).withColumnRenamed("value", "ids_crc32")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
