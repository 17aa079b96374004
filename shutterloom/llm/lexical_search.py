"""Ranked lexical search: summed accumulators of short lists as one bounded iterator beside long lists.

Index (`build`). A task reads its documents in order and closes a shard when it
holds enough words: for every term of the shard the places of the documents
that hold it and how often, in the order of documents, with the documents' ids
and lengths. A shard is one row of a Parquet table, so no list is longer than a
shard and nothing is shuffled. Numbers of documents holding a term, of
documents and of terms are summed over all shards.

Search (`search`). Items are taken in blocks of bounded size, each against all
shards, which are the ranges of documents that the search goes through in
order. In a shard an item's lists come shortest first. The short ones, up to a
bound of postings together, are added up term at a time: each document that any
of them holds has an accumulator. From then on this is a single list with a
single bound, the largest sum. Together with the long lists it is gone through
a range of documents at a time: as long as the bounds of the remaining lists
could still carry a document of their own past the item's threshold (the score
of its last place so far, over all shards of the task), their documents become
candidates; once they can't, the rest of a long list is only looked into at the
candidates' places, and candidates whose sum and remaining bounds stay below
the threshold are dropped before that. A list without candidates left is never
read. Scores are integers, so the result is that of scoring everything.

Documents are rows: each row is ranked by itself, also if it repeats an id or
has none (such rows come last among equal scores). Null, empty and wordless
texts are no documents of the corpus and match nothing. Rows of items are
ranked one by one too; items without terms give no rows. Terms are compared by
64-bit hashes of their bytes. Texts are looked through whole, whatever their
length; a shard ends with the document that fills it. Empty tables give no
rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, Tables, as_bytes, bounded_batches, by_bytes, hashed_words, table

#: Words that fill a shard, and documents that it has at most.
SHARD_WORDS, SHARD_DOCS = 1 << 20, 1 << 16
#: Bytes of text whose words a task hashes at once.
TEXT_BYTES = 1 << 20
#: Rows of shards in an Arrow batch: a shard has some megabytes.
SHARDS_AT_ONCE = 4
#: Postings that short lists have together at most, as a part of a shard's documents.
SHORT_PART = 0.5
#: Terms of the items that are searched for in one pass over the index (12 bytes each).
BLOCK_TERMS = 1 << 20

#: How to write shards: small row groups, as a reader holds whole groups.
WRITER = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "2", "parquet.page.size.row.check.min": "2"}

_INDEX = "ids array<long>, known array<boolean>, lengths array<long>, terms array<long>, starts array<long>, docs binary, counts binary"


class _Builder:
    """Collects documents until they fill a shard."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.words = 0

    def add(self, doc: int | None, hashes: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.ids.append(doc)
        self.lengths.append(len(hashes))
        self.words += len(hashes)

    def full(self) -> bool:
        return self.words >= SHARD_WORDS or len(self.ids) >= SHARD_DOCS

    def shard(self) -> pa.RecordBatch:
        h = np.concatenate([np.zeros(0, np.uint64), *self.hashes])
        doc = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.lengths)
        order = np.argsort(h, kind="stable")  # documents stay in order inside a term
        h, doc = h[order], doc[order]
        new = np.flatnonzero((h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) + 1
        first = np.concatenate((np.zeros(min(1, len(h)), np.int64), new))
        counts = np.diff(np.append(first, len(h))).astype("<u4")
        h, doc = h[first], doc[first]
        starts = np.concatenate((np.zeros(min(1, len(h)), np.int64), np.flatnonzero(h[1:] != h[:-1]) + 1))
        lists = lambda x, kind: pa.array([x], pa.list_(kind))
        columns = [
            lists([i or 0 for i in self.ids], pa.int64()),
            lists([i is not None for i in self.ids], pa.bool_()),
            lists(self.lengths, pa.int64()),
            lists(h[starts].view(np.int64), pa.int64()),
            lists(np.append(starts, len(h)), pa.int64()),
            pa.array([doc.astype("<u2").tobytes()], pa.binary()),
            pa.array([counts.tobytes()], pa.binary()),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=["ids", "known", "lengths", "terms", "starts", "docs", "counts"])


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of an index of `docs`, a row each; write them with the options `WRITER`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Builder()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for i, k in by_bytes(texts, TEXT_BYTES):
                hashes, begins = hashed_words(texts[i:k], ALNUM_TABLE)
                for doc, a, b in zip(ids[i:k], begins.tolist(), begins[1:].tolist(), strict=False):
                    if b > a:
                        own.add(doc, hashes[a:b])
                        if own.full():
                            yield own.shard()
        if own.ids:
            yield own.shard()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, _INDEX)


@dataclass(frozen=True)
class Corpus:
    """Numbers over all documents: documents with terms, terms with repeats, and for terms of items the documents holding them."""

    docs: int
    terms: int
    holding: dict[int, int] = field(repr=False)

    def weight(self, term: int) -> int:
        """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * self.holding.get(term, 0) + 1)))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """100 - 50 + (50 n N) div L of documents with n terms."""
        if len(lengths) and int(lengths.max()) * self.docs > (1 << 63) // 50:  # beyond 64 bits
            return np.array([50 + 50 * n * self.docs // self.terms for n in lengths.tolist()], np.int64)
        return 50 + 50 * lengths * self.docs // max(1, self.terms)


def holding(index: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Rows (term, n): in how many documents of the index each of some terms (sorted hashes, of a block) stands."""
    known = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                terms, starts = (np.asarray(batch.column(c)[r].values) for c in (0, 1))
                at, there = _places(terms, known.value)
                total[there] += starts[at[there] + 1] - starts[at[there]]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.value[hit].view(np.int64)), pa.array(total[hit])], names=["term", "n"])

    return index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _places(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of `wanted` would stand in a shard's terms (signed view of sorted hashes), and whether it does."""
    own = terms.view(np.uint64)
    at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
    return at, own[at] == wanted if len(own) else np.zeros(len(wanted), bool)


class Shard:
    """A shard with what scoring needs: lists by term, lengths as norms."""

    def __init__(self, row: dict[str, pa.Scalar], corpus: Corpus):
        self.ids, self.lengths = (np.asarray(row[c].values) for c in ("ids", "lengths"))
        self.known = np.array(row["known"].values.to_pylist(), bool)
        self.terms, self.starts = (np.asarray(row[c].values) for c in ("terms", "starts"))
        self.docs = np.frombuffer(row["docs"].as_buffer(), "<u2")
        self.counts = np.frombuffer(row["counts"].as_buffer(), "<u4")
        self.norms = corpus.norms(self.lengths)
        self.least_norm = int(self.norms.min()) if len(self.norms) else 50

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, weight) of the lists of those terms that the shard has and that weigh anything."""
        at, there = _places(self.terms, terms)
        there &= weights > 0
        return [(int(self.starts[k]), int(self.starts[k + 1]), int(w)) for k, w in zip(at[there].tolist(), weights[there].tolist(), strict=True)]

    def scores(self, begin: int, end: int, weight: int, of: np.ndarray | None = None) -> np.ndarray:
        """The scores of a list's postings, or of some of them."""
        tf, doc = self.counts[begin:end].astype(np.int64), self.docs[begin:end]
        if of is not None:
            tf, doc = tf[of], doc[of]
        return weight * (1_000_000_000 * tf // (1000 * tf + 20 * self.norms[doc]))

    def bound(self, begin: int, end: int, weight: int) -> int:
        """No posting of the list scores more."""
        tf = int(self.counts[begin:end].max())
        return weight * (1_000_000_000 * tf // (1000 * tf + 20 * self.least_norm))


def accumulated(shard: Shard, short: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of some lists in order, with their summed scores."""
    total = np.zeros(len(shard.ids), np.int64)
    for begin, end, weight in short:
        total[shard.docs[begin:end]] += shard.scores(begin, end, weight)  # a document stands once in a list
    docs = np.flatnonzero(total)
    return docs, total[docs]


def best_of_shard(shard: Shard, lists: list[tuple[int, int, int]], most: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places) of a shard that may be among the `most` best, with their scores.

    Left out is only what scores less than `threshold`, or less than `most`
    others of the shard.
    """
    lists = sorted(lists, key=lambda x: x[1] - x[0])
    room, n_short = SHORT_PART * len(shard.ids), 0
    while n_short < len(lists) and (room := room - (lists[n_short][1] - lists[n_short][0])) >= 0:
        n_short += 1
    docs, sums = accumulated(shard, lists[:n_short])
    long = sorted(((shard.bound(*x), x) for x in lists[n_short:]), reverse=True)
    # rest[i]: no document gains more from the long lists i, i + 1, ...
    rest = np.concatenate((np.cumsum([b for b, _ in long][::-1], dtype=np.int64)[::-1], [0])) if long else np.zeros(1, np.int64)

    def raised(low: int, sums: np.ndarray) -> int:
        return max(low, int(np.partition(sums, -most)[-most])) if len(sums) >= most else low

    threshold = raised(threshold, sums)
    if sums.max(initial=0) + rest[0] < threshold:
        return docs[:0], sums[:0]
    for i, (_, (begin, end, weight)) in enumerate(long):
        if rest[i] >= max(1, threshold):
            # a document that only the remaining lists hold can still get in: all of this list's are candidates
            own = shard.docs[begin:end].astype(np.int64)
            at = np.searchsorted(docs, own)
            old = at < len(docs)
            old[old] = docs[at[old]] == own[old]
            gain = shard.scores(begin, end, weight)
            sums = sums.copy()
            sums[at[old]] += gain[old]
            docs, sums = np.concatenate((docs, own[~old])), np.concatenate((sums, gain[~old]))
            order = np.argsort(docs, kind="stable")
            docs, sums = docs[order], sums[order]
        else:
            # only candidates that can still get in are looked up, by skipping to their places
            alive = sums + rest[i] >= threshold
            docs, sums = docs[alive], sums[alive]
            if not len(docs):
                break
            at = np.searchsorted(shard.docs[begin:end], docs)
            there = at < end - begin
            there[there] = shard.docs[begin:end][at[there]] == docs[there]
            sums = sums.copy()
            sums[there] += shard.scores(begin, end, weight, at[there])
        threshold = raised(threshold, sums)
    kept = (sums >= max(1, threshold)) & (sums > 0)
    return docs[kept], sums[kept]


def _items(items: DataFrame, item_id: str, text: str, tables: Tables) -> DataFrame:
    """Rows (item, key, terms) of items with terms: a number of the row, its id, its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, begins = hashed_words(as_bytes(batch.column(1)), ALNUM_TABLE)
            terms = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["key", "terms"])

    kind = items.schema[item_id].dataType.simpleString()
    cut = items.select(F.col(f"`{item_id}`").alias("key"), F.col(f"`{text}`")).mapInArrow(run, f"key {kind}, terms array<long>").filter(F.size("terms") > 0)
    return tables.keep(cut.withColumn("item", F.monotonically_increasing_id()), "items")


def _searched(index: DataFrame, asked: pa.Table, corpus: Corpus, most: int) -> DataFrame:
    """Rows (item, doc_id, known, score): for each item of a block the best documents of every task."""
    numbers = asked.column("item").to_pylist()
    hashes = [np.array(t, np.int64).view(np.uint64) for t in asked.column("terms").to_pylist()]
    weights = [np.array([corpus.weight(t) for t in h.tolist()], np.int64) for h in hashes]
    shipped = index.sparkSession.sparkContext.broadcast((numbers, hashes, weights, Corpus(corpus.docs, corpus.terms, {})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, hashes, weights, corpus = shipped.value
        far = np.iinfo(np.int64).max
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in numbers]
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}, corpus)
                for i, (h, w) in enumerate(zip(hashes, weights, strict=True)):
                    lists = shard.lists(h, w)
                    if not lists:
                        continue
                    ids, known, scores = best[i]
                    docs, sums = best_of_shard(shard, lists, most, int(scores[-1]) if len(scores) == most else 0)
                    if not len(docs):
                        continue
                    ids, known, scores = np.concatenate((ids, shard.ids[docs])), np.concatenate((known, shard.known[docs])), np.concatenate((scores, sums))
                    order = np.lexsort((np.where(known, ids, far), -scores))[:most]
                    best[i] = ids[order], known[order], scores[order]
        for i, (ids, known, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), numbers[i])), pa.array(ids, mask=~known), pa.array(scores)], names=["item", "doc", "score"])

    return index.mapInArrow(run, "item long, doc long, score long")


def search(index: DataFrame, items: DataFrame, most: int = 50, item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The `most` best documents of an index for each row of `items`: item_id, rank (from 1), doc_id, score.

    `index` is a table of shards as `build` makes it, read from where it was
    written.
    """
    spark = index.sparkSession
    tables = Tables(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    asked = _items(items, item_id, text, tables)
    spark.conf.set(name, str(SHARDS_AT_ONCE))  # what reads shards runs inside this function
    try:
        facts = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)), F.lit(0))).first()
        total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        blocks = -(-total // block_terms)
        found = None
        for b in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").toArrow()
            if not block.num_rows:
                continue
            wanted = np.unique(np.concatenate([np.array(t, np.int64).view(np.uint64) for t in block.column("terms").to_pylist()]))
            held = holding(index, wanted).toArrow()
            known = dict(zip(held.column("term").to_numpy().view(np.uint64).tolist(), held.column("n").to_pylist(), strict=True))
            one = tables.keep(_searched(index, block, Corpus(facts[0], facts[1], known), most), f"found-{b}")
            found = one if found is None else found.unionByName(one)
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    if found is None:
        kind = items.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], f"`{item_id}` {kind}, rank int, doc_id long, score long")
    rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most)
    return ranked.join(asked.select("item", "key"), "item").select(F.col("key").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    index = tables.keep(build(table(spark, sf_dir, "documents")), "index", **WRITER)
    found = tables.keep(search(index, table(spark, sf_dir, "benchmark"), 50), "ranked")
    tables.drop("index")
    return found


_SPLIT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY r, doc_id, n, t),
held AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
i AS (SELECT row_number() OVER () AS q, item_id, {_SPLIT} AS w FROM benchmark),
asked AS (SELECT DISTINCT q, item_id, t FROM (SELECT q, item_id, unnest(w) AS t FROM i)),
weighed AS (SELECT q, item_id, t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM asked JOIN held USING (t), corpus),
scored AS (
  SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM weighed JOIN tf USING (t), corpus GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
