"""Quality by ordinal regression.

Ratings are grades 0 to K. One weight vector over hashed words (each present
word counts once) and hashed signs of form (share of signs, capitals,
repetition) gives a score s; ordered thresholds turn it into
P(grade >= k) = sigmoid(s - t_k). The fit maximises the likelihood of the
grades by mini-batch AdaGrad with an L1 term; it uses one text each of at most
`rows_most` labelled keys, those with the smallest hash. Of several grades of
a key the lowest counts, of several texts of a key the one with the smallest
hash; what comes to the driver is bounded by keys, however often they repeat.

Null and empty texts have no words and get the score of their form alone.
Texts of any length are rated whole; each row gets its own rating, repeated
ones the same. Without labels all weights are 0 and each tail is a half. An
empty table gives no rows. Other columns of either table don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, as_bytes, bounded_batches, by_bytes, distinct, hashed_words, table

BITS = 18
#: A bucket gets a weight if so many texts of the sample have it.
LEAST_TEXTS = 4
#: Bytes of text that are rated at once.
TEXT_BYTES = 1 << 19
_LETTERS = bytes(range(0x41, 0x5B))
_PLAIN = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *b" \t\r\n"])


def form(text: bytes, words: int, different: int) -> list[bytes]:
    """Signs of form as words that no text has: shares in steps."""
    n = max(len(text), 1)
    signs = len(text.translate(None, _PLAIN)) / n
    capitals = (len(text) - len(text.translate(None, _LETTERS))) / n
    many = words.bit_length()
    return [b"\x01signs%d" % min(int(signs * 40), 20), b"\x01capitals%d" % int(capitals * 20), b"\x01words%d" % many, b"\x01distinct%d,%d" % (int(10 * different / max(words, 1)), many)]


def units(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the buckets of its distinct words and of its signs of form."""
    for i, k in by_bytes(texts, TEXT_BYTES):
        h, begins = hashed_words(texts[i:k], ALNUM_TABLE)
        own = [distinct(np.sort(h[a:b])) for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)]
        signs = [s for text, n, found in zip(texts[i:k], np.diff(begins).tolist(), own, strict=True) for s in form(text, n, len(found))]
        marks = hashed_words(signs)[0].reshape(k - i, -1)
        for words, more in zip(own, marks, strict=True):
            yield (np.concatenate((words, more)) & np.uint64((1 << BITS) - 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[bytes]) -> list[float]:
        return [float(self.weights[own].sum(dtype=np.float64)) for own in units(texts)]

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def fit(buckets: list[np.ndarray], grades: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.1, l1: float = 2e-4) -> Model:
    """Weights and thresholds for rows of hashed units and their grades."""
    top = int(grades.max(initial=1))
    seen = np.bincount(np.concatenate(buckets), minlength=1 << BITS) if buckets else np.zeros(1 << BITS, int)
    usable = seen >= LEAST_TEXTS
    rows = [b[usable[b]] for b in buckets]
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    share = np.clip([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, top + 1)], 0.01, 0.99)
    t = -np.log(share / (1 - share))
    t2 = np.full(top, 1e-8)
    order = np.random.default_rng(7)
    for _ in range(epochs if len(rows) else 0):
        places = order.permutation(len(rows))
        for i in range(0, len(places), batch):
            pick = places[i : i + batch]
            sizes = [len(rows[j]) for j in pick]
            cols, row = np.concatenate([rows[j] for j in pick]), np.repeat(np.arange(len(pick)), sizes)
            s, y = np.bincount(row, w[cols], len(pick)), grades[pick]
            tail = np.concatenate((np.ones((len(pick), 1)), 1 / (1 + np.exp(np.clip(t - s[:, None], -50, 50))), np.zeros((len(pick), 1))), 1)
            at, above = tail[np.arange(len(pick)), y], tail[np.arange(len(pick)), y + 1]
            ds = 1 - at - above  # of the log likelihood by s
            own = np.bincount(cols, ds[row], 1 << BITS) / len(pick)
            hit = np.flatnonzero(own)
            g2[hit] += own[hit] ** 2
            step = rate / np.sqrt(g2[hit])
            moved = w[hit] + step * own[hit]
            w[hit] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            p = np.maximum(at - above, 1e-9)
            density = tail * (1 - tail)
            dt = np.array([(density[:, k] * ((y == k - 1).astype(float) - (y == k)) / p).mean() for k in range(1, top + 1)])
            t2 += dt**2
            t = np.maximum.accumulate(t + rate * dt / np.sqrt(t2))
    return Model(w, t)


def train(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text: str = "text", rows_most: int = 16_000) -> Model:
    """A model from the texts of at most `rows_most` keys of `labels` with a grade."""
    bounded_batches(docs.sparkSession)
    graded = labels.select(F.col(f"`{id_col}`").alias("k"), grade.cast("int").alias("g")).filter("k IS NOT NULL AND g IS NOT NULL")
    chosen = graded.groupBy("k").agg(F.min("g").alias("g")).orderBy(F.xxhash64("k"), "k").limit(rows_most)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(own) for own in units(as_bytes(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.int32()))], names=["g", "k", "h", "units"])

    kind = graded.schema["k"].dataType.simpleString()
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    found = rows.join(F.broadcast(chosen), F.col("i") == F.col("k")).select("t", "g", "k", "h").mapInArrow(buckets, f"g int, k {kind}, h long, units array<int>")
    # one text a key, before anything comes to the driver
    got = found.groupBy("k", "g").agg(F.min_by("units", "h").alias("units")).toArrow().sort_by("k")
    column = got.column("units").combine_chunks()
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    return fit([values[a:b] for a, b in zip(ends, ends[1:], strict=False)], got.column("g").to_numpy())


def rate(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(grade, tail) of a string column: the expected grade and the probability of the highest one."""
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    @F.arrow_udf("struct<grade:double,tail:double>")
    def rated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shipped.value)
        for texts in batches:
            tails = [own.tails(score) for score in own.scores(as_bytes(texts))]
            yield pa.StructArray.from_arrays([pa.array([float(x.sum()) for x in tails], pa.float64()), pa.array([float(x[-1]) for x in tails], pa.float64())], names=["grade", "tail"])

    return rated(text)


#: Texts are selected from this probability of the highest grade on.
SELECT_FROM = 0.5


def grade_of_labels() -> Column:
    """0 for low quality, 1 for toxic texts, 2 for the rest; null where a label is."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), grade_of_labels())
    rated = docs.select("doc_id", rate(spark, model, F.col("text")).alias("r"))
    return rated.select("doc_id", F.col("r.grade").alias("expected_grade"), F.col("r.tail").alias("p_top"), (F.col("r.tail") >= SELECT_FROM).alias("selected"))
