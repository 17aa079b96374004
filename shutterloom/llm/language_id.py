"""Language identification, word first.

A model holds, for each language, the log frequency of known words and of
character n-grams of 5 down to 1 letters (words framed by `^` and `$`). A
known word scores by its own frequencies; an unseen one by the mean over its
known n-grams of the longest length that has any. A text's score is the sum
over its words. Texts without a letter, null and empty texts, and all texts of
a model without languages are `und` with score 0; of equally good languages
the first by name is given.

The fit takes at most `docs_most` distinct labelled texts of each language,
those with the smallest hash of key and text, and keeps all their words and
n-grams. The bound is a parameter of `train`; it holds for each language by
itself, so a rare language is learned beside a dominant one. A model holds
scores only of the languages that an entry was seen in; of the others it
has one score for each length. Rows that repeat key and
text count once in the fit; each row gets its own prediction. Texts of any
length are scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, Words, as_bytes, bounded_batches, by_bytes, table

GRAM_MOST = 5
#: A language's share among words or n-grams that it was never seen with.
SMOOTH = 0.5
#: Scores count as if of so many words at most, so that long texts don't all end at 1.
WORDS_IN_SCORE = 20
#: Unseen words whose scores a task remembers, and bytes of these scores.
WORDS_KEPT, BYTES_KEPT = 100_000, 16 << 20
#: Bytes of text that are scored at once.
TEXT_BYTES = 1 << 19
#: Words of one text whose scores are summed at once.
ROWS = 1 << 16


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a framed word; single letters without the frame."""
    framed = f"^{word}$"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)] if n > 1 else list(word)


def unit_key(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "replace"))


def has_letter(text: bytes) -> bool:
    return text.lower() != text.upper() or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


class Scores:
    """Sorted 64-bit keys with a score for each language: those of the languages that a key was seen in, else the language's score of unseen keys."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        """One item per key and language, with its count."""
        order = np.lexsort((lang, key))
        key, lang, n = key[order], lang[order], n[order]
        new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        self.keys, self.starts = key[new], np.append(new, len(key)).astype(np.int64)
        below = np.bincount(lang, n, langs) + SMOOTH * max(len(new), 1)
        self.lang = lang.astype(np.int32)
        self.score = np.log((n + SMOOTH) / below[lang]).astype(np.float32)
        self.never = np.log(SMOOTH / below).astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its place (or any) and whether it is listed."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The scores of the keys at some places, one column per language."""
        out = np.repeat(self.never[None], len(at), 0)
        times = self.starts[at + 1] - self.starts[at]
        owner = np.repeat(np.arange(len(at)), times)
        each = np.repeat(self.starts[at] - (np.cumsum(times) - times), times) + np.arange(len(owner))
        out[owner, self.lang[each]] = self.score[each]
        return out


class Model:
    """Languages, scores of words, and scores of n-grams by their length (16 bytes a key, and 8 for each language that it was seen in)."""

    def __init__(self, langs: list[str], size: np.ndarray, lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        """One item per entry and language: the entry's size (0 for words, else letters), the language's place, its key and count."""
        self.langs = langs
        self.by_size = [Scores(key[size == k], lang[size == k], n[size == k], len(langs)) for k in range(GRAM_MOST + 1)]

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """Rows of scores of unseen words: the mean over the known n-grams of the longest length that has any."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = [(i, w.decode("utf-8", "replace")) for i, w in enumerate(words)]
        for size in range(GRAM_MOST, 0, -1):
            if not left:
                break
            found = [grams(w, size) for _, w in left]
            owner = np.repeat(np.arange(len(left)), list(map(len, found)))
            keys = np.fromiter((unit_key(g) for own in found for g in own), np.uint64, len(owner))
            scores = self.by_size[size]
            at, known = scores.find(keys)
            times = np.bincount(owner[known], minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner[known], scores.rows(at[known]))
            hit = times > 0
            out[[i for (i, _), h in zip(left, hit.tolist(), strict=True) if h]] = sums[hit] / times[hit, None]
            left = [x for x, h in zip(left, hit.tolist(), strict=True) if not h]
        return out

    def predictor(self):
        """A function from texts to languages and scores, which remembers a bounded number of unseen words."""
        place: dict[int, int] = {}
        most = max(1, min(WORDS_KEPT, BYTES_KEPT // (4 * max(1, len(self.langs)))))
        memory = np.zeros((most, len(self.langs)), np.float32)

        def rows_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
            """Rows of scores of the distinct words, and each word's place in them."""
            keys, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            at, known = self.by_size[0].find(keys)
            rows = np.zeros((len(keys), len(self.langs)), np.float32)
            rows[known] = self.by_size[0].rows(at[known])
            lacking = np.flatnonzero(~known)
            held = np.fromiter((place.get(k, -1) for k in keys[lacking].tolist()), np.int64, len(lacking))
            rows[lacking[held >= 0]] = memory[held[held >= 0]]
            fresh = lacking[held < 0]
            rows[fresh] = self.unseen([words[i] for i in first[fresh].tolist()])
            if len(place) + len(fresh) > most:
                place.clear()
            kept = fresh[:most]
            memory[len(place) : len(place) + len(kept)] = rows[kept]
            place.update(zip(keys[kept].tolist(), range(len(place), len(place) + len(kept)), strict=True))
            return rows, inverse

        def predict(texts: list[bytes]) -> tuple[list[str], list[float]]:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if not self.langs:
                return langs, scores
            for i, k in by_bytes(texts, TEXT_BYTES):
                words = Words(texts[i:k], ALNUM_TABLE)
                rows, inverse = rows_of(words)
                for j in range(i, k):
                    if not has_letter(texts[j]):
                        continue
                    a, b = int(words.begins[j - i]), int(words.begins[j - i + 1])
                    total = sum((rows[inverse[p : min(p + ROWS, b)]].sum(0, dtype=np.float64) for p in range(a, b, ROWS)), np.zeros(len(self.langs)))
                    total *= min(1.0, WORDS_IN_SCORE / max(b - a, 1))
                    odds = np.exp(total - total.max())
                    best = int(odds.argmax())
                    langs[j], scores[j] = self.langs[best], float(odds[best] / odds.sum())
            return langs, scores

        return predict


def sampled(rows: DataFrame, group: str, key: Column, most: int) -> DataFrame:
    """Of each group at most `most` rows with different `key`, those with the smallest keys; other columns are those of one row of the key.

    Only keys are ranked, at most `most` of a group from each task; the chosen
    keys are bounded by groups and `most` and go to all executors.
    """
    keyed = rows.withColumn("_key", key)
    ranked = keyed.select(group, "_key").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_key"))).filter(F.col("_r") <= most)
    last = ranked.groupBy(group).agg(F.max("_key").alias("_last")).select(F.col(group).alias("_group"), "_last")
    chosen = keyed.join(F.broadcast(last), (F.col(group) == F.col("_group")) & (F.col("_key") <= F.col("_last")))
    return chosen.groupBy(group, "_key").agg(*[F.first(c).alias(c) for c in rows.columns if c != group]).drop("_key")


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_most: int = 2_000) -> Model:
    """A model from rows with text and language."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: dict[str, Counter] = {}
            for name, own in zip(batch.column(1).to_pylist(), as_bytes(batch.column(0)), strict=True):
                counted.setdefault(name, Counter()).update(own.translate(ALNUM_TABLE).split())
            for name, words in counted.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and their n-grams as keys; `size` 0 for words."""
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                words = part.column(1).to_pylist()
                units: Counter = Counter()
                for name, key, w, n in zip(part.column(0).to_pylist(), Words(words, ALNUM_TABLE).hashes.tolist(), words, part.column(2).to_pylist(), strict=True):
                    units[name, 0, key] += n
                    word = w.decode("utf-8", "replace")
                    for size in range(1, GRAM_MOST + 1):
                        for g in grams(word, size):
                            units[name, size, unit_key(g)] += n
                keys = list(units)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(np.array([k[2] for k in keys], np.uint64).view(np.int64)), pa.array([units[k] for k in keys], pa.int64())], names=["lang", "size", "unit", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    chosen = sampled(rows, "l", F.xxhash64("k", "t"), docs_most)
    words = chosen.select("t", "l").mapInArrow(count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(count_units, "lang string, size int, unit long, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))
    got = counts.select("lang", "size", "unit", "n").toArrow().combine_chunks()
    names = pc.dictionary_encode(got.column("lang").combine_chunks())
    found = names.dictionary.to_pylist()
    langs = sorted(found)
    place = np.array([langs.index(x) for x in found], np.int64)
    code = place[names.indices.to_numpy()] if found else np.zeros(0, np.int64)
    size, unit, n = (got.column(c).to_numpy() for c in ("size", "unit", "n"))
    return Model(langs, size, code, unit.view(np.uint64), n.astype(np.int64))


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang, score) of a string column."""
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shipped.value.predictor()
        for texts in batches:
            langs, scores = own(as_bytes(texts))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predicted(text)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from the fit: crc32 of its id as text, mod 5, is 0. A null id isn't."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out(F.col("doc_id"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, learned(docs), F.col("text")).alias("p"))
    return judged.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
