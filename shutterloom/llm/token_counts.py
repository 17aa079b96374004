"""Token counts of whole texts: lengths only, never the ids.

A text is cut at white space where the tokenizer's own pre-tokenizer drops
white space anyway, so the counts of the pieces add up to the count of the
whole text; long texts without white space are cut at other safe places
(`Cuts`). Distinct pieces are encoded in batches, once per task as long as
they stay in a bounded cache. Tokenizers for which white space is not a safe
boundary go through the forced boundaries of `bpe` (byte-level files), or
encode whole texts (piece models).

Null and empty texts count 0. Rows are kept as they are, repeated ones too; an
empty table stays empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import bpe
from .common import Memory, as_bytes, bounded_batches, by_bytes, one_thread, tokenizer_path

#: Pieces of each generation that a task remembers, and the longest one that it keeps on.
CACHE_ITEMS, CACHE_BYTES = 350_000, 128
#: A longer text is cut into parts of about this size before its pieces are listed.
PART_BYTES = 1 << 20
#: New pieces go to the library by so many bytes.
BATCH_BYTES = 1 << 16
#: Signs that the pre-tokenizer always parts from a letter or digit before them (an apostrophe or `|>` may belong to it).
_SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def drops_white_space(path: str) -> bool:
    """Whether the file's pre-tokenizer keeps only matches that hold no white space."""
    steps = json.load(open(path, encoding="utf-8")).get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and " ?" not in str(first)


class Cuts:
    """Places at which a text may be parted so that the counts of its parts add up.

    White space is one, where the pre-tokenizer drops it. A run without any is
    parted before a digit, where the pre-tokenizer gives each digit by itself,
    or else between two ideographs whose bytes at the cut stand together in no
    token of the vocabulary, so that no merge reaches across. The part before
    such a cut isn't the end of its word; it is counted with the ideograph that
    follows, whose own count is taken off. Runs that have none of these stay
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.digits = rb"|[\\p{N}]|" in open(path, "rb").read()
        alphabet = bpe.byte_alphabet()
        self.inside = np.zeros((256, 256), bool)
        for token in Tokenizer.from_file(path).get_vocab(with_added_tokens=False):
            known = np.array([alphabet.get(c, -1) for c in token.removesuffix("</w>")], np.int64)
            pairs = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0))
            self.inside[known[pairs], known[pairs + 1]] = True

    def place(self, text: bytes, low: int, high: int) -> tuple[int, bytes]:
        """The last place of a cut from `low` on and before `high` (else -1), and the ideograph that the part before it is counted with."""
        if (cut := max(text.rfind(c, low, high) for c in (b" ", b"\n", b"\t"))) >= 0:
            return cut, b""
        if self.digits and (cut := max(text.rfind(b"%d" % d, low, high) for d in range(10))) >= 0:
            return cut, b""
        # two characters of U+5000 to U+8FFF, all of them letters that neither compose nor have a case
        at = max(low - 3, 0)
        w = np.frombuffer(text, np.uint8, min(high + 3, len(text)) - at, at)
        lead, rest = (w >= 0xE5) & (w <= 0xE8), (w & 0xC0) == 0x80
        whole = lead[:-2] & rest[1:-1] & rest[2:]
        found = np.flatnonzero(whole[:-3] & whole[3:] & ~self.inside[w[2:-3], w[3:-2]]) if len(w) > 5 else []
        return (at + int(found[-1]) + 3, text[at + found[-1] + 3 : at + found[-1] + 6]) if len(found) else (-1, b"")

    def parts(self, text: bytes, most: int) -> Iterator[tuple[bytes, bytes]]:
        """`text` in parts of about `most` bytes, each with what is to be added and whose count is to be taken off again."""
        start = 0
        while len(text) - start > most:
            cut, after, low = -1, b"", start + 1
            while cut < 0 and low < len(text):
                cut, after = self.place(text, low, min(max(start + most, low + most // 2), len(text)))
                low = max(start + most, low + most // 2)
            if cut < 0:
                break
            yield text[start:cut], after
            start = cut
        yield text[start:], b""


def folded(text: bytes) -> bytes:
    """`text` with A-Z in lower case where the tokenizer's own folding gives the same words: no special string, no mark that composes with a letter."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


class WordCounter:
    """Counts by white-space pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        one_thread()
        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.known = Memory(CACHE_ITEMS, CACHE_BYTES)
        self.cuts = Cuts(path)
        self.mark = self.encode(["\0"], add_special_tokens=False)[0].ids

    def learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Counts of words by the batch: one text of many words with a mark between them, so that the library is called seldom."""
        found: dict[bytes, int] = {}
        plain = [w for w in words if b"\0" not in w] if len(self.mark) == 1 else []
        for i, k in by_bytes(plain, BATCH_BYTES):
            text = " \0 ".join([w.decode("utf-8", "replace") for w in plain[i:k]]) + " \0"
            ends = np.flatnonzero(np.array(self.encode([text], add_special_tokens=False)[0].ids) == self.mark[0])
            found.update(zip(plain[i:k], (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))
        rest = [w for w in words if w not in found]
        for i, k in by_bytes(rest, BATCH_BYTES):
            found.update(zip(rest[i:k], (len(e) for e in self.encode([w.decode("utf-8", "replace") for w in rest[i:k]], add_special_tokens=False)), strict=True))
        return found

    def __call__(self, texts: list[bytes]) -> list[int]:
        out = [0] * len(texts)
        for i, k in by_bytes(texts, PART_BYTES):
            if k - i == 1 and len(texts[i]) > PART_BYTES:  # part by part, so that memory doesn't grow with what is made of the text
                for part, after in self.cuts.parts(texts[i], PART_BYTES):
                    out[i] += self.added([folded(part + after).split()])[0] - (self.added([[after]])[0] if after else 0)
            else:
                out[i:k] = self.added([folded(t).split() for t in texts[i:k]])
        return out

    def added(self, pieces: list[list[bytes]]) -> list[int]:
        """The sum of each list's counts."""
        self.know([w for words in pieces for w in words])
        known = self.known.young
        sums = [sum(map(known.__getitem__, words)) for words in pieces]
        self.known.trim()
        return sums

    def know(self, words: list[bytes]) -> None:
        """Sees to it that all these words are known; a word that ends in signs is the sum of its two sides."""
        if not (lacking := self.known.missing(words)):
            return
        sides = {w: (core, w[len(core) :]) for w in lacking if (core := w.rstrip(_SIGNS)) and core != w and core[-1] in _ALNUM}
        basis = {w for w in lacking if w not in sides}.union(*sides.values())
        young = self.known.young
        young.update(self.learn(self.known.missing(list(basis))))
        young.update((w, young[a] + young[b]) for w, (a, b) in sides.items())


class PieceCounter:
    """Counts of a sentencepiece model, whole texts in batches."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[bytes]) -> list[int]:
        out: list[int] = []
        for i, k in by_bytes(texts):
            out += map(len, self.model.encode([t.decode("utf-8", "replace") for t in texts[i:k]], num_threads=1))
        return out


@lru_cache(maxsize=4)
def counter(tokenizer: str) -> Callable[[list[bytes]], list[int]]:
    path = tokenizer_path(tokenizer)
    if path.endswith(".model"):
        return PieceCounter(path)
    if drops_white_space(path):
        return WordCounter(path)
    codec = bpe.codec(tokenizer)
    return lambda texts: [len(ids) // 4 for ids in codec.encode_all(texts)]


def token_count(text: Column, tokenizer: str = "word_bpe_49k.json") -> Column:
    """Tokens of a string column, without special tokens; special strings in texts as the library's default has them."""

    @F.arrow_udf(LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = counter(tokenizer)
        try:
            for texts in batches:
                yield pa.array(counts(as_bytes(texts)), pa.int64())
        finally:
            if isinstance(counts, WordCounter):
                counts.known.clear()

    return count(text)


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048, out: str = "n_tokens") -> DataFrame:
    """`docs` with `n_bytes`, the tokens as `out`, and `over_limit`; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in {"n_bytes", out, "over_limit"}]
    return (
        docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(f"`{text}`"), tokenizer).alias(out))
        .withColumn("over_limit", F.col(out) > limit)
    )
