"""Byte-pair encoding and decoding with forced boundaries.

A merge makes a vocabulary token, so two bytes that stand next to each other
in no token of the vocabulary are never merged across: between them every
encoding has a cut. `Codec` marks these places in the whole text at once (a
look-up of byte pairs), encodes each distinct fragment by itself with the
tokenizers library, and joins the ids. The pre-tokenizer must see the same
pieces in a fragment as in the whole text; therefore no cut is made after
white space, before an apostrophe that follows a sign, inside a character, or
inside the text of a special token.

Null and empty texts have no ids and decode to an empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import Memory, as_bytes, bounded_batches, by_bytes, one_thread, tokenizer_path

#: Fragments of each generation that a task remembers, and the longest one that it keeps on.
CACHE_ITEMS, CACHE_BYTES = 150_000, 96
#: Texts are handled by so many bytes, a longer one in parts that end at forced boundaries.
PART_BYTES = 1 << 20
#: New fragments go to the library by so many bytes.
BATCH_BYTES = 1 << 16

#: Last bytes of the white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028-9, U+202F, U+205F, U+3000).
_SPACE_ENDS = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]

#: White space in the sense of the tokenizers' pattern, twice in a row or more.
_RUN = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}")
#: Bytes that all white space beyond ASCII has, and a table that makes a space of white space in ASCII.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_TO_SPACE = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
#: The byte-level pattern for texts without such runs, where it needs no look-ahead.
_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def has_run(raw: bytes, text: str) -> bool:
    """Whether white space stands twice in a row; texts without any beyond ASCII are looked through as bytes."""
    return bool(_RUN.search(text)) if any(s in raw for s in _WIDE) else b"  " in raw.translate(_TO_SPACE)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        one_thread()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
        alphabet = byte_alphabet()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.forced = self.forced_pairs(self.bytes_of, [s.encode() for s in special])
        self.special = list(special)
        self.ranked = self.by_rank(path, vocabulary)
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids
        self.known = Memory(CACHE_ITEMS, CACHE_BYTES)

    def by_rank(self, path: str, vocabulary: dict[str, int]):
        """An encoder that merges by the rank of the result, for files whose ids follow the order of their merges (then both ways give the same ids)."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in json.load(open(path, encoding="utf-8"))["model"].get("merges", [])]
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(made) + 256 + len(self.special) != len(vocabulary):
            return None
        ranks = {self.bytes_of[i]: i for t, i in vocabulary.items() if t not in self.special}
        return tiktoken.Encoding("ranked", pat_str=_SINGLE, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def forced_pairs(tokens: list[bytes], special: list[bytes]) -> np.ndarray:
        """For each pair of bytes (first * 256 + second): 1 a certain cut, 2 one if the first byte does not end white space, 0 none."""
        inside = np.zeros(65536, bool)
        joined = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        ends = np.cumsum([len(t) for t in tokens])
        pairs = joined[:-1] * 256 + joined[1:]
        real = np.ones(len(pairs), bool)
        real[ends[(ends > 0) & (ends < len(joined))] - 1] = False
        inside[pairs[real]] = True
        for s in special:
            inside[[a * 256 + b for a, b in zip(s, s[1:], strict=False)]] = True
        forced = (~inside).astype(np.uint8).reshape(256, 256)
        forced[:, 0x80:0xC0] = 0  # inside a character
        for a in range(256):
            if a in b" \t\n\r\x0b\x0c" or 0x1C <= a <= 0x1F:
                forced[a] = 0
            elif not (0x30 <= a <= 0x39 or 0x41 <= a <= 0x5A or 0x61 <= a <= 0x7A):
                forced[a, 0x27] = 0
        forced[_SPACE_ENDS] *= 2
        return forced.reshape(-1)

    def cuts(self, text: bytes) -> list[int]:
        """Places of the certain cuts, the text's begin and end included."""
        b = np.frombuffer(text, np.uint8)
        if len(b) < 2:
            return [0, len(b)] if len(b) else [0]
        kind = self.forced[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        at = np.flatnonzero(kind)
        unsure = kind[at] == 2
        if unsure.any():
            # The character is white space at most if it is C2 xx, or has three bytes from E1, E2 or E3 on.
            k = at[unsure]
            one, two = b[np.maximum(k - 1, 0)], b[np.maximum(k - 2, 0)]
            drop = (one == 0xC2) | ((two >= 0xE1) & (two <= 0xE3))
            keep = np.ones(len(at), bool)
            keep[np.flatnonzero(unsure)[drop]] = False
            at = at[keep]
        return [0, *(at + 1).tolist(), len(b)]

    def learn(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        """Ids of fragments by the batch.

        Fragments without white space but for one space in front are put into
        one text with a line end between them: that is a token of its own
        there and stands in none of them, so the encoder is called seldom.
        """
        found: dict[bytes, bytes] = {}
        texts = [f.decode("utf-8", "replace") for f in fragments]
        plain = [i for i, t in enumerate(texts) if t.split() == [t.removeprefix(" ")]] if len(self.line_end) == 1 else []
        for i, k in by_bytes([fragments[j] for j in plain], BATCH_BYTES):
            ids = self.stream("\n".join([texts[j] for j in plain[i:k]]) + "\n")
            ends = np.flatnonzero(ids == self.line_end[0]).tolist()
            packed = ids.tobytes()
            found.update(zip((fragments[j] for j in plain[i:k]), (packed[4 * (a + 1) : 4 * b] for a, b in zip([-1, *ends], ends, strict=False)), strict=True))
        rest = [(f, t) for f, t in zip(fragments, texts, strict=True) if f not in found]
        for i in range(0, len(rest), 256):
            for (f, _), e in zip(rest[i : i + 256], self.library.encode_batch_fast([t for _, t in rest[i : i + 256]], add_special_tokens=False), strict=True):
                found[f] = np.array(e.ids, "<u4").tobytes()
        return found

    def stream(self, text: str) -> np.ndarray:
        """Ids of a text; by the ranked encoder where white space stands alone and no special string occurs."""
        if self.ranked is None or self.has_special(text) or _RUN.search(text):
            return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return np.array(self.ranked.encode_ordinary(text), "<u4")

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode_stream(self, texts: list[bytes]) -> list[bytes]:
        """As `encode_all`, without remembering fragments: those between two runs of white space go to the ranked encoder as one, for their ids only follow each other."""
        out = [b""] * len(texts)
        rest = []
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            if self.ranked is None or len(raw) > PART_BYTES or self.has_special(text) or has_run(raw, text):
                rest.append(i)
            else:
                ids = array("I", self.ranked.encode_ordinary(text))
                if sys.byteorder != "little":
                    ids.byteswap()
                out[i] = ids.tobytes()
        for i, packed in zip(rest, self.encode_all([texts[i] for i in rest]), strict=True):
            out[i] = packed
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; the memory in use follows `PART_BYTES` and the longest text."""
        out: list[bytes] = []
        for i, k in by_bytes(texts, PART_BYTES):
            group = texts[i:k]
            if len(group) == 1 and len(group[0]) > PART_BYTES:
                out.append(b"".join(self.encode_parts(list(self.parts(group[0])))))
            else:
                out += self.encode_parts(group)
        return out

    def parts(self, text: bytes) -> Iterator[bytes]:
        start = 0
        for cut in self.cuts(text)[1:]:
            if cut - start >= PART_BYTES or cut == len(text):
                yield text[start:cut]
                start = cut

    def encode_parts(self, texts: list[bytes]) -> list[bytes]:
        fragments = []
        for text in texts:
            at = self.cuts(text)
            fragments.append([text[i:k] for i, k in zip(at, at[1:], strict=False)])
        known = self.known
        if lacking := known.missing(list(chain.from_iterable(fragments))):
            known.young.update(self.learn(lacking))
        look = known.young.__getitem__
        out = [b"".join(map(look, own)) for own in fragments]
        known.trim()
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(tokenizer: str) -> Codec:
    return Codec(tokenizer_path(tokenizer))


def id_slices(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row; none for null."""
    ends = np.asarray(column.offsets)
    values = np.asarray(column.values).astype("<u4", copy=False)
    for i, k in zip(ends, ends[1:], strict=False):
        yield values[i:k]


def encode(text: Column, tokenizer: str = "byte_bpe_50k.json") -> Column:
    """Ids of a string column as array<int>."""

    @F.arrow_udf(ArrayType(IntegerType(), False))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(tokenizer)
        try:
            for texts in batches:
                packed = own.encode_all(as_bytes(texts))
                ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        finally:
            own.known.clear()

    return ids(text)


def decode(ids: Column, tokenizer: str = "byte_bpe_50k.json") -> Column:
    """Text of an array<int> column; null and empty arrays give an empty text, bytes that are no UTF-8 the replacement sign."""

    @F.arrow_udf(StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(tokenizer)
        for column in batches:
            yield pa.array([own.decode(x) for x in id_slices(column)], pa.string())

    return text(ids)


def ids_sha256(ids: Column) -> Column:
    """Lower-case hex digest of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf(StringType())
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in id_slices(column)], pa.string())

    return digest(ids)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """For each row: the key as `id_col`, `ids`, and `decoded`, the text of these ids.

    Both steps run in one worker, about a megabyte of text at a time. A column
    `ids_sha256` (see `ids_sha256`) comes with them, so that the ids need not go
    to a worker once more for it. Repeated rows give repeated results, an empty
    table none; other columns of `docs` don't matter, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        try:
            for batch in batches:
                texts = as_bytes(batch.column(1))
                for i, k in by_bytes(texts, PART_BYTES):
                    packed = own.encode_all(texts[i:k])
                    ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                    decoded = pa.array([own.decode(x) for x in id_slices(ids)], pa.string())
                    marks = pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, k - i), ids, decoded, marks], names=[id_col, "ids", "decoded", "ids_sha256"])
        finally:
            own.known.clear()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string, ids_sha256 string")
