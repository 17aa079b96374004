"""Benchmark decontamination by a positional inverted index.

Test items are cut into windows of consecutive words (an item with fewer
words is one window). Corpus counts of the test vocabulary give the two
rarest words of each window with their offsets; the index stores, for every
document, the positions of those words only. For each window the lists of
its rarest word are joined first; then the second list, shifted by its
offset, is intersected in one pass over both: an equal start is a phrase
candidate, one within `slop` words a proximity match. Phrase candidates are
checked word by word against the document, of which only those with
candidates are shuffled.

Texts are compared by words: A-Z in lower case, everything ASCII that is no
letter or digit between them. In the index words are 64-bit hashes; the check
compares the words themselves. Null and empty texts have no words. Texts of any
length are looked through whole, in time linear in their length. A document is
its id (null is one too) and its text: repeated rows are judged once, and each
of them gets the result. Items with the same id count as one; of equally rare
words the one with the smaller hash, then offset, is taken, which changes no
phrase match. Empty tables give no rows or no matches. Other columns of either
table don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, Tables, as_bytes, bounded_batches, by_bytes, hashed_words, sieved, table

WINDOW = 13
#: Up to so many distinct test words are sent to all executors (8 bytes each); more are joined.
MOST_TERMS = 4_000_000
#: Bytes of text whose words a task hashes at once.
TEXT_BYTES = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def windows(items: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """One row per distinct window of an item: item (string), w (its words joined by spaces)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, own in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(own)
                found = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
                out += [(item, w.decode("utf-8", "replace")) for w in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([w for _, w in out], pa.string())], names=["item", "w"])

    return items.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).mapInArrow(cut, "item string, w string").distinct()


def window_terms(cut: DataFrame) -> DataFrame:
    """The words of each distinct window: w, o (offset), term (hash)."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, begins = hashed_words(as_bytes(batch.column(0)), ALNUM_TABLE)
            sizes = np.diff(begins)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.arange(len(h)) - begins[owner], pa.int32()), pa.array(h.view(np.int64))], names=["w", "o", "term"])

    return cut.select("w").distinct().mapInArrow(terms, "w string, o int, term long")


class Terms:
    """Sorted hashes of words, with flags by their low bits in front of the search."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.flags = np.zeros(1 << self.BITS, bool)
        self.flags[keys & np.uint64((1 << self.BITS) - 1)] = True

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are listed, and where."""
        maybe = np.flatnonzero(self.flags[h & np.uint64((1 << self.BITS) - 1)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        same = self.keys[at] == h[maybe]
        return maybe[same], at[same]


def _shipped(terms: DataFrame, most: int):
    """The terms for all executors if they are few enough (they are counted first), else None."""
    if terms.count() > most:
        return None
    keys = np.array([r[0] for r in terms.select("term").collect()], np.int64).view(np.uint64)
    return terms.sparkSession.sparkContext.broadcast(Terms(keys))


def term_counts(docs: DataFrame, terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """How often each of `terms` (term) stands in the texts of `docs` (text); 0 where it does not."""
    known = _shipped(terms, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value.keys) if known else 0, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i, k in by_bytes(texts, TEXT_BYTES):
                h, _ = hashed_words(texts[i:k], ALNUM_TABLE)
                if known:
                    total += np.bincount(known.value.places(h)[1], minlength=len(total))
                else:
                    keys, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])
        if known:
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(known.value.keys[hit].view(np.int64)), pa.array(total[hit])], names=["term", "n"])

    counts = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def index(docs: DataFrame, terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """Of `docs` (doc, mark, text): rows (doc, mark, term, positions) for `terms`, and a row (doc, mark, n_words) for each document."""
    known = _shipped(terms, most)
    kind = docs.schema["doc"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "mark", "term", "positions", "n_words"]
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for i, k in by_bytes(texts, TEXT_BYTES):
                docs, marks = batch.column(0).slice(i, k - i), batch.column(1).slice(i, k - i)
                h, begins = hashed_words(texts[i:k], ALNUM_TABLE)
                yield pa.RecordBatch.from_arrays([docs, marks, pa.nulls(k - i, pa.int64()), pa.nulls(k - i, pa.list_(pa.int32())), pa.array(np.diff(begins), pa.int64())], names=names)
                at = known.value.places(h)[0] if known else np.arange(len(h))
                if not len(at):
                    continue
                text = np.searchsorted(begins, at, "right") - 1
                order = np.lexsort((at, h[at], text))
                at, text = at[order], text[order]
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(h[at], prepend=~h[at[:1]]) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(at - begins[text], pa.int32()))
                own = pa.array(text[new])
                yield pa.RecordBatch.from_arrays([docs.take(own), marks.take(own), pa.array(h[at[new]].view(np.int64)), lists, pa.nulls(len(own), pa.int64())], names=names)

    out = docs.select("doc", "mark", "text").mapInArrow(post, f"doc {kind}, mark long, term long, positions array<int>, n_words long")
    return out if known else out.filter("term IS NULL").unionByName(out.filter("term IS NOT NULL").join(terms, "term", "left_semi"))


def rarest(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their rarest word and the second (null for windows of one word): w, t1, o1, t2, o2."""
    ranked = terms.join(counts, "term").groupBy("w").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "o"))), 1, 2).alias("r"))  # a window has at most WINDOW words
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return ranked.select("w", one["term"].alias("t1"), one["o"].alias("o1"), two["term"].alias("t2"), two["o"].alias("o2"))


def matches(postings: DataFrame, picked: DataFrame, slop: int = 3) -> DataFrame:
    """Candidates: doc, mark, w, exact (starts that both lists give), near (whether other starts are within `slop` words)."""
    first = postings.join(picked, F.col("term") == F.col("t1")).select("doc", "mark", "w", "t2", "o2", F.transform("positions", lambda p: p - F.col("o1")).alias("starts"))
    second = postings.select(F.col("doc").alias("d2"), F.col("mark").alias("m2"), F.col("term").alias("term2"), F.col("positions").alias("p2"))
    both = first.join(second, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("mark") == F.col("m2")) & (F.col("t2") == F.col("term2")), "left").filter("t2 IS NULL OR p2 IS NOT NULL")
    kind = postings.schema["doc"].dataType.simpleString()

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both lists are in order, so each start meets its neighbours in the second list."""
        for batch in batches:
            kept, exact, near = [], [], []
            for row, (a, b, o) in enumerate(zip(batch.column(3), batch.column(4), batch.column(5).to_pylist(), strict=True)):
                begin = np.asarray(a.values, np.int64)
                if o is None:  # a window of one word
                    kept.append(row)
                    exact.append(begin)
                    near.append(False)
                    continue
                other = np.asarray(b.values, np.int64) - o
                right = np.minimum(np.searchsorted(other, begin), len(other) - 1)
                distance = np.minimum(np.abs(other[right] - begin), np.abs(other[np.maximum(right - 1, 0)] - begin))
                close = (distance <= slop) & (begin >= 0)
                if close.any():
                    kept.append(row)
                    exact.append(begin[close & (distance == 0)])
                    near.append(bool((close & (distance > 0)).any()))
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), pa.array([x.tolist() for x in exact], pa.list_(pa.int32())), pa.array(near, pa.bool_())], names=["doc", "mark", "w", "exact", "near"])

    return both.select("doc", "mark", "w", "starts", "p2", "o2").mapInArrow(intersect, f"doc {kind}, mark long, w string, exact array<int>, near boolean")


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 3, most_terms: int = MOST_TERMS) -> DataFrame:
    """Per document row: id, n_words, n_hit, items (sorted ids of items with occurring windows), near_items (with proximity matches only), contaminated."""
    tables = Tables(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    cut = tables.keep(windows(items, item_id, item_text, size), "cut")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
    terms = window_terms(cut)
    picked = tables.keep(rarest(terms, term_counts(rows, terms.select("term").distinct(), most_terms)), "windows")
    chosen = picked.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term IS NOT NULL").distinct()
    whole = tables.keep(index(rows, chosen, most_terms), "postings")
    # repeated rows have equal lists
    postings = whole.filter("term IS NOT NULL").groupBy("doc", "mark", "term").agg(F.first("positions").alias("positions"))
    found = tables.keep(matches(postings, picked, slop), "candidates")

    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    per_doc = found.groupBy(F.col("doc").alias("d"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("w", "exact")).alias("candidates"))
    texts = sieved(rows, F.col("mark"), found, F.col("mark")).groupBy("doc", "mark").agg(F.first("text").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, exact, near = [], [], []
            for own, candidates in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = words_of(own)
                hit = np.zeros(len(words) + 1, np.int32)
                exact.append([])
                near.append([])
                for c in candidates:
                    window = c["w"].encode().split(b" ")
                    here = [s for s in c["exact"] if words[s : s + len(window)] == window]
                    for s in here:
                        hit[s] += 1
                        hit[s + len(window)] -= 1
                    (exact if here else near)[-1].append(c["w"])
                n_hit.append(int((np.cumsum(hit)[: len(words)] > 0).sum()))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(exact, strings), pa.array(near, strings)], names=["doc", "mark", "n_hit", "exact", "near"])

    hits = tables.keep(texts.join(per_doc, same).select("doc", "mark", "text", "candidates").mapInArrow(verify, f"doc {kind}, mark long, n_hit long, exact array<string>, near array<string>"), "hits")
    # many items can share a window, and many documents too: items meet matches only here, one row each before they are listed
    by_window = hits.select("doc", "mark", F.explode("exact").alias("w"), F.lit(True).alias("whole")).unionByName(hits.select("doc", "mark", F.explode("near").alias("w"), F.lit(False).alias("whole")))
    by_item = by_window.join(cut, "w").groupBy("doc", "mark", "item").agg(F.max("whole").alias("whole"))
    listed = by_item.groupBy(F.col("doc").alias("d"), F.col("mark").alias("m")).agg(F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("item")))).alias("items"), F.array_sort(F.collect_list(F.when(~F.col("whole"), F.col("item")))).alias("near_items"))
    results = tables.keep(hits.select("doc", "mark", "n_hit").join(listed, same, "left").select(F.col("doc").alias("d"), F.col("mark").alias("m"), "n_hit", "items", "near_items"), "results")
    tables.drop("cut", "windows", "candidates", "hits")

    none = F.expr("cast(array() AS array<string>)")
    judged = whole.filter("term IS NULL").select("doc", "mark", "n_words").join(results, same, "left")
    out = judged.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def digest(items: list[str]) -> str:
    """What the query gives for a list of items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, len(w) AS n, array_to_string(w, ' ') AS g FROM b WHERE len(w) BETWEEN 1 AND 12
  UNION
  SELECT DISTINCT item, 13, array_to_string(w[s : s + 12], ' ') FROM (SELECT item, w, unnest(range(1, len(w) - 11)) AS s FROM b WHERE len(w) >= 13)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, grams.n AS n, item FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
