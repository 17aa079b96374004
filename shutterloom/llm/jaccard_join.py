"""Near duplicates by the Jaccard similarity of word shingles.

Documents with equal shingle sets fall together first; one representative
each goes on. Shingles are ordered rare first, by the corpus counts of their
hash buckets (a fixed number of counters, from all documents) and by hash.
Two sets of the wanted similarity share a shingle in their prefixes, so the
representatives are joined on prefix shingles:

* In each list of a prefix shingle the smallest representative is the anchor.
  Representatives that share many prefix shingles with an anchor form a family
  (components of these strong links). All pairs inside a family are compared
  exactly in tiles of a bounded number of sets, with no pair written out.
* Pairs of different families in one list pass the length, positional and
  suffix filters, fall together to one row a pair, and are verified once.

Inside a family nearly all sets share their prefixes, so the filters can't part
them there. What one task holds is bounded: a tile by sets and bytes, a list by
its parts. Sets are told apart by 128 bits of their shingles; shingles and
words are 64-bit hashes.

Links give components; a document's component is the smallest id reachable.
Texts without words, empty and null texts have no shingles and link with
nothing. Repeated ids are treated as one document each time they occur: rows
are kept, and they share the component of their text. Rows without an id link
like others; their component is null only if none of its rows has an id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterloom.operators.components import connected_components

from .common import SPACED_TABLE, Tables, as_bytes, bounded_batches, by_bytes, distinct, hashed_words, sieved, table

#: Counters of shingle buckets; what is sent to all executors has this size (4 bytes each) for any input.
BUCKETS = 1 << 22
#: A task counts up to this in a bucket; more doesn't change what is rare.
MOST_COUNT = 65_535
#: Lists of a shingle whose bucket counts more are headed in parts of about so many sets.
HOT_LIST = 20_000
#: Sets, and bytes of sets, in a tile of a family.
TILE, TILE_BYTES = 2048, 16 << 20
#: Bits of the outline of a small set; larger sets have a bit for about two shingles.
OUTLINE_BITS = 256
#: Two representatives are strongly linked if they share this part of the shorter prefix.
STRONG = 0.25
#: Bytes of text whose shingles a task makes at once.
TEXT_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Shingles of `size` words; similar from `percent` hundredths of the union on."""

    size: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        """How many of n ordered shingles two similar sets must meet in."""
        return n - -(-self.percent * n // 100) + 1


#: What near duplicates are unless a contract says otherwise.
NEAR = Rule()


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the distinct 64-bit keys of its shingles, ascending; a shorter sequence is one shingle."""
    for i, k in by_bytes(texts, TEXT_BYTES):
        h, begins = hashed_words(texts[i:k], SPACED_TABLE)
        keys = _mixed_runs(h, size) if len(h) >= size else h[:0]
        for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False):
            own = np.sort(keys[a : b - size + 1]) if b - a >= size else _mixed_runs(h[a:b], b - a) if b > a else h[:0]
            yield distinct(own)


def _mixed_runs(h: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of n words."""
    key = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        key = (key ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key * np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes, size: int) -> np.ndarray:
    return next(shingle_sets([text], size))


def set_keys(keys: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs: its key, and the one in use if different sets have that key."""
    digest = hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def outline(keys: np.ndarray) -> bytes:
    """Bits of a set for the suffix filter: whether an odd number of its keys falls into each of so many equal ranges (a power of two)."""
    bits = max(OUTLINE_BITS, 1 << max(0, (len(keys) // 2 - 1).bit_length()))
    odd = np.bincount((keys >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differences(one: bytes, two: bytes) -> int:
    """Ranges in which two outlines differ, each of which holds a shingle that only one set has; the finer outline is folded to the other."""
    a, b = sorted((np.unpackbits(np.frombuffer(one, np.uint8)), np.unpackbits(np.frombuffer(two, np.uint8))), key=len)
    return int((a ^ np.bitwise_xor.reduce(b.reshape(len(a), -1), 1)).sum())


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc, n, key, key2, outline) for documents and (chunk, counts) with the bucket counts of each task, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint16)
        names = ["doc", "n", "key", "key2", "outline", "chunk", "counts"]
        for batch in batches:
            texts, n, keys, lines = as_bytes(batch.column(1)), [], [], []
            for i, k in by_bytes(texts, TEXT_BYTES):
                found = list(shingle_sets(texts[i:k], size))
                n += map(len, found)
                keys += map(set_keys, found)
                lines += map(outline, found)
                # of a bucket that occurs more than once only the last sum is kept, so sums are made by sorting
                buckets = np.sort((np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.uint32))
                ends = np.flatnonzero(np.diff(buckets, append=~buckets[-1:]))
                buckets, times = buckets[ends], np.diff(ends, prepend=-1)
                counts[buckets] = np.minimum(counts[buckets] + times, MOST_COUNT)
            one, two = np.array(keys, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(one), pa.array(two), pa.array(lines, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        parts = counts.reshape(64, -1)
        for i in range(64):
            if parts[i].any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1)], pa.binary())], names=names)

    return docs.select("doc", "text").mapInArrow(run, "doc long, n int, key long, key2 long, outline binary, chunk int, counts binary")


def bucket_counts(found: DataFrame) -> np.ndarray:
    """The counters over all tasks: 64 chunks, each summed by a task; what comes to the driver has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((64, BUCKETS // 64), np.uint32)
    summed = found.filter("chunk IS NOT NULL").select("chunk", "counts").repartition(64, "chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    for chunk, counts in zip(summed.column(0).to_pylist(), summed.column(1), strict=True):
        out[chunk] = np.frombuffer(counts.as_buffer(), np.uint32)
    return out.reshape(-1)


def postings(docs: DataFrame, counts: np.ndarray, rule: Rule, clashing: frozenset[int]) -> DataFrame:
    """Prefix shingles (h, part, key, n, pos) of every document; a task writes those of equal sets once.

    `part` is -1, or deals the sets of a shingle that may be very common to a few parts.
    """
    shipped, hot = docs.sparkSession.sparkContext.broadcast(counts), HOT_LIST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = shipped.value, set()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i, k in by_bytes(texts, TEXT_BYTES):
                h, part, key, n, pos = [], [], [], [], []
                for keys in shingle_sets(texts[i:k], rule.size):
                    mark, second = set_keys(keys)
                    mark = second if mark in clashing else mark
                    if not len(keys) or mark in done:
                        continue
                    done.add(mark)
                    first = rule.prefix(len(keys))
                    # rare buckets first, then by key: one order for all documents
                    often = order[keys & np.uint64(BUCKETS - 1)]
                    rank = often.astype(np.uint64) << np.uint64(32) | keys >> np.uint64(32)
                    by = np.argsort(rank, kind="stable")[:first]
                    often = often[by].astype(np.int64)
                    h.append(keys[by])
                    part.append(np.where(often > hot, mark % (often // hot + 1), -1))
                    key.append(np.full(first, mark, np.int64))
                    n.append(np.full(first, len(keys), np.int32))
                    pos.append(np.arange(first, dtype=np.int32))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(part), pa.int32()), pa.array(np.concatenate(key)), pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))], names=["h", "part", "key", "n", "pos"])
                if len(done) > 500_000:
                    done.clear()

    return docs.select("text").mapInArrow(run, "h long, part int, key long, n int, pos int")


class _Sets:
    """Local union of sets by their place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def tile_links(keys: list[int], sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Spanning links among sets of one tile; of two sides only pairs across are compared.

    Shared shingles are counted through the tile's own inverted lists. A set
    is compared only if some other is not in its component yet, so sets around
    a common centre cost little more than one round.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    by = np.argsort(values, kind="stable")
    values, owner = values[by], owner[by]
    side = np.array(sides)
    two = len(set(sides)) > 1
    root = np.arange(len(sets))  # the first set of each component
    for i, own in enumerate(sets):
        asked = root != root[i]
        asked[: i + 1] = False
        if two:
            asked &= side != side[i]
        # the length filter
        asked &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        if not asked.any():
            continue
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero(asked & (100 * shared >= percent * (sizes + sizes[i] - shared)))
        if len(hit):
            met = np.unique(np.append(root[hit], root[i]))
            root[np.isin(root, met)] = met[0]
    return [(keys[i], keys[r]) for i, r in enumerate(root.tolist()) if r != i]


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) inside families from rows (family, tiles, key, shingles); a family of many tiles is compared tile by tile."""
    mine = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    with_tile = members.withColumn("t", mine)
    spread = with_tile.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = spread.select("family", F.least("t", "other").alias("a"), F.greatest("t", "other").alias("b"), "t", "key", "shingles")

    def run(tile: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in tile.column("shingles").to_pylist()]
        links = tile_links(tile.column("key").to_pylist(), sets, tile.column("t").to_pylist(), percent)
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["src", "dst"])

    return tiles.groupBy("family", "a", "b").applyInArrow(run, "src long, dst long")


def may_link(percent: int):
    """The suffix filter: whether two sets' outlines and sizes allow the similarity."""

    @F.arrow_udf("boolean")
    def allowed(a: pa.Array, b: pa.Array, size_a: pa.Array, size_b: pa.Array) -> pa.Array:
        sizes = size_a.to_numpy(zero_copy_only=False) + size_b.to_numpy(zero_copy_only=False).astype(np.int64)
        differ = np.array([differences(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], np.int64)
        return pa.array((100 + percent) * differ <= (100 - percent) * sizes, pa.bool_())

    return allowed


def similar(percent: int):
    @F.arrow_udf("boolean")
    def linked(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one.to_pylist(), two.to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pa.array(out, pa.bool_())

    return linked


def prefix_lists(listed: DataFrame, any_hot: bool, tables: Tables) -> DataFrame:
    """Lists (h, key, n, pos, anchor, anchor_n) of shingles in the prefixes of two sets or more; the anchor is the smallest key.

    Only (h, part) meet in one task, so a list that may be very long is headed
    in parts, whose heads then fall together.
    """
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = listed.repartition(parts, "h", "part").groupBy("h", "part", "key").agg(F.first("n").alias("n"), F.min("pos").alias("pos"))
    whole = Window.partitionBy("h", "part")
    headed = once.withColumns({"head": F.min(F.struct("key", "n")).over(whole), "m": F.count("*").over(whole)}).filter("m > 1 OR part >= 0")
    headed = tables.keep(headed.select("h", "part", "key", "n", "pos", F.col("head.key").alias("anchor"), F.col("head.n").alias("anchor_n"), "m"), "prefix-lists")
    columns = ["h", "key", "n", "pos", "anchor", "anchor_n"]
    if not any_hot:
        return headed.select(columns)
    hot = headed.filter("part >= 0")
    heads = hot.filter("key = anchor").groupBy("h").agg(F.min(F.struct("key", "n")).alias("head"), F.sum("m").alias("m")).filter("m > 1")
    joined = hot.select("h", "key", "n", "pos").join(heads.select("h", F.col("head.key").alias("anchor"), F.col("head.n").alias("anchor_n")), "h")
    return headed.filter("part < 0").select(columns).unionByName(joined.select(columns))


def cross_pairs(lists: DataFrame, families: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs (a, b) of sets in different families that the length and positional filters allow.

    In each list those outside the list's own family (its anchor's) meet all others.
    """
    home = families.select(F.col("node").alias("k"), F.col("component").alias("f"))
    placed = lists.select("h", "key", "n", "pos", "anchor").join(home, F.col("key") == F.col("k"), "left").withColumn("f", F.coalesce("f", "key")).drop("k")
    placed = placed.join(home.select(F.col("k").alias("ka"), F.col("f").alias("fa")), F.col("anchor") == F.col("ka"), "left").withColumn("fa", F.coalesce("fa", "anchor"))
    mixed = placed.select("h", "key", "n", "pos", "f", (F.col("f") == F.col("fa")).alias("at_home"))
    strays = mixed.filter("NOT at_home").select(F.col("h").alias("h2"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("f").alias("f2"))
    # at the first shingle that two sets share, no more than the rest of either can be shared; there a similar pair passes
    room = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    kept = (F.col("h") == F.col("h2")) & (F.col("f") != F.col("f2")) & (F.col("at_home") | (F.col("key") < F.col("key2"))) & (100 * F.least("n", "n2") >= rule.percent * F.greatest("n", "n2")) & ((100 + rule.percent) * room >= rule.percent * (F.col("n") + F.col("n2")))
    return mixed.join(strays, kept).select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rule: Rule = NEAR) -> DataFrame:
    """Per row: the key as `id_col`, n_shingles, component_id."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    tables = Tables(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    found = tables.keep(summaries(rows, rule.size), "shingle-sets")
    counts = bucket_counts(found)
    per_doc = found.filter("chunk IS NULL").select("doc", "n", "key", "key2", "outline")
    # different sets with one 64-bit key: by n sets of which n * n / 2^65 are expected, so there are few if any
    clashing = per_doc.filter("n > 0").groupBy("key").agg(F.min("key2").alias("one"), F.max("key2").alias("two")).filter("one <> two").select("key")
    clashing = frozenset(r[0] for r in clashing.collect())
    if clashing:
        per_doc = per_doc.withColumn("key", F.when(F.col("key").isin(*clashing), F.col("key2")).otherwise(F.col("key")))
    # equal sets have equal sizes and outlines
    reps = tables.keep(per_doc.filter("n > 0").groupBy("key").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("outline").alias("outline")), "representatives")

    lists = prefix_lists(postings(rows, counts, rule, clashing), bool((counts > HOT_LIST).any()), tables)
    prefix = lambda n: F.col(n) - F.ceil(F.col(n) * rule.percent / 100) + 1
    strong = lists.filter("key <> anchor").groupBy("key", "anchor", "n", "anchor_n").agg(F.count("*").alias("hits")).filter(F.col("hits") >= STRONG * F.least(prefix("n"), prefix("anchor_n")))
    families = tables.keep(connected_components(strong, "key", "anchor"), "families")

    # the suffix filter needs outlines alone: sets are made only for pairs that pass it
    line = lambda side: reps.select(F.col("key").alias(side), F.col("n").alias(f"size_{side}"), F.col("outline").alias(f"outline_{side}"))
    outlined = cross_pairs(lists, families, rule).join(line("a"), "a").join(line("b"), "b")
    pairs = tables.keep(outlined.filter(may_link(rule.percent)("outline_a", "outline_b", "size_a", "size_b")).select("a", "b"), "pairs")
    tables.drop("prefix-lists")

    sizes = families.join(reps.select(F.col("key").alias("node"), "n"), "node").groupBy("component").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("tiles"))
    in_family = families.join(sizes, "component").select(F.col("node").alias("key"), F.col("component").alias("family"), "tiles")
    in_pair = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    members = in_family.withColumn("paired", F.lit(False)).unionByName(in_pair.withColumn("paired", F.lit(True)), allowMissingColumns=True)
    needed = members.groupBy("key").agg(F.max("family").alias("family"), F.max("tiles").alias("tiles"), F.max("paired").alias("paired"))
    wanted = tables.keep(reps.select("rep", "key").join(needed, "key"), "wanted")
    texts = sieved(rows, F.xxhash64("doc"), wanted, F.xxhash64("rep")).join(wanted, F.col("doc") == F.col("rep")).select("key", "family", "tiles", "paired", "text")

    def mark(keys: np.ndarray) -> int:
        one, two = set_keys(keys)
        return two if one in clashing else one

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = as_bytes(batch.column(0))
            for i, k in by_bytes(own, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(map(mark, shingle_sets(own[i:k], rule.size)), pa.int64()), batch.column(0).slice(i, k - i)], names=["own", "text"])

    # sets that only rows without an id hold are found by their key, one text each
    nameless = rows.filter("doc IS NULL AND text IS NOT NULL").select("text").mapInArrow(to_keys, "own long, text string").groupBy("own").agg(F.first("text").alias("text"))
    texts = texts.unionByName(wanted.filter("rep IS NULL").join(nameless, F.col("key") == F.col("own")).select("key", "family", "tiles", "paired", "text"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = as_bytes(batch.column("text"))
            for i, k in by_bytes(own, TEXT_BYTES):
                part = batch.slice(i, k - i)
                # rows with a repeated id may have another text
                sets = list(shingle_sets(own[i:k], rule.size))
                same = pa.array([mark(s) == key for key, s in zip(part.column("key").to_pylist(), sets, strict=True)], pa.bool_())
                held = part.select(["key", "family", "tiles", "paired"]).append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary()))
                yield held.filter(same)

    sets = tables.keep(texts.mapInArrow(to_sets, "key long, family long, tiles int, paired boolean, shingles binary"), "sets")
    # a representative whose id has several rows may come as often: one set a key, so that tiles hold what they are made for
    own = per_doc.filter("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("rows")).filter("rows > 1")
    repeated = tables.keep(wanted.join(own, F.col("rep") == F.col("doc"), "left_semi").select("key"), "repeated")
    if repeated.take(1):
        once = sets.join(repeated, "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("family", "tiles", "paired", "shingles")])
        sets = tables.keep(sets.join(repeated, "key", "left_anti").unionByName(once), "single-sets")
        tables.drop("sets")
        tables.paths["sets"] = tables.paths.pop("single-sets")
    tables.drop("repeated")
    inside = family_links(sets.filter("family IS NOT NULL").select("family", "tiles", "key", "shingles"), rule.percent)
    paired = sets.filter("paired").select("key", "shingles")
    verified = pairs.join(paired.toDF("a", "set_a"), "a").join(paired.toDF("b", "set_b"), "b").filter(similar(rule.percent)(F.col("set_a"), F.col("set_b")))
    links = tables.keep(inside.unionByName(verified.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "links")
    tables.drop("wanted", "sets", "pairs", "families")

    # components by key, named by their smallest document
    groups = connected_components(links).select(F.col("node").alias("key"), "component")
    named = reps.select("key", "rep").join(groups, "key")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_key = named.join(smallest, "component").select("key", "component_id")
    # a table of its own, so that Spark can split the rows of a set that very many documents have
    classes = tables.keep(reps.select("key", "rep").join(by_key, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id")), "classes")
    tables.drop("links", "representatives")
    out = per_doc.select("doc", "n", F.when(F.col("n") > 0, F.col("key")).alias("own")).join(classes, F.col("own") == F.col("key"), "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN component c ON c.node = d.doc_id
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), rule=Rule(size=4, percent=85))
