"""Content and perceptual fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the head and tail of a quick signature; sides of the grey and colour grids.
QUICK_BYTES = 256 * 1024
GREY, COLOUR = 32, 4
#: Bytes of an image that are held as floats at once.
STRIPE_BYTES = 8 << 20


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def colour_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference; 255 where a signature is missing, empty or of another length."""
    known = (F.size(a) > 0) & (F.size(a) == F.size(b))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(known, F.lit(False)), total / F.size(a)).otherwise(F.lit(255.0))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def quick_signature(content: Column) -> Column:
    """sha256 of the size (64 bits, little endian), the first 256 KiB, and the last 256 KiB if there are more than 512."""
    body = content.cast("binary")
    size = F.octet_length(body)
    little = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(size.cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))), ""))
    tail = F.when(size > 2 * QUICK_BYTES, F.substring(body, -QUICK_BYTES, QUICK_BYTES)).otherwise(F.lit(b""))
    return F.sha2(F.concat(little, F.substring(body, 1, QUICK_BYTES), tail), 256)


def content_identity(content_hash: Column, quick_signature: Column, item_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("sha:"), content_hash), F.concat(F.lit("q:"), quick_signature), F.concat(F.lit("u:"), item_id.cast("string")))


def phash_of_coefficients(coefficients: Column) -> Column:
    """64 transform coefficients as bits: bit i is set if coefficient i is above the median (mean of the 32nd and 33rd)."""
    wide = F.transform(coefficients, lambda x: x.cast("double"))

    def bits(one: Column) -> Column:
        median = (F.element_at(one["sorted"], 32) + F.element_at(one["sorted"], 33)) / 2
        shifted = F.transform(one["c"], lambda x, i: F.when(x > median, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(shifted, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    # a list of one element names the sorted values, so that they are sorted once a row
    once = F.transform(F.array(F.struct(wide.alias("c"), F.array_sort(wide).alias("sorted"))), bits)
    return F.when(F.size(coefficients) == 64, F.element_at(once, 1))


def frame_agreement(a: Column, b: Column, tolerance: int) -> Column:
    """struct(ratio, mean): part of the longer sequence's frames that agree place by place, mean distance of the compared; (0, 64) if one is empty."""
    n = F.least(F.size(a), F.size(b))
    distances = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: hamming64(x, y))
    within = F.size(F.filter(distances, lambda d: d <= tolerance)).cast("double")
    total = F.aggregate(distances, F.lit(0.0), lambda s, d: s + d)
    some = F.coalesce(n, F.lit(0)) > 0
    return F.struct(F.when(some, within / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0)).alias("ratio"), F.when(some, total / n).otherwise(F.lit(64.0)).alias("mean"))


def sampling_times(duration: Column, samples: int = 5) -> Column:
    """The seconds at which a video's frames are taken; 2 to 16 samples."""
    n = min(16, max(2, samples))
    return F.when(duration > 0, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k * duration / (n + 1)))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(GREY)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / GREY), np.sqrt(2 / GREY))
    return scale * np.cos((2 * x + 1) * k * np.pi / (2 * GREY))


def _weights(n: int, side: int) -> np.ndarray:
    """The part that each of `n` places has in each of `side` cells of equal length."""
    edges = np.linspace(0, n, side + 1)
    lo, hi = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
    w = np.clip(np.minimum(hi, edges[1:, None]) - np.maximum(lo, edges[:-1, None]), 0, None)
    return w / w.sum(1, keepdims=True)


def _shrunk(pixels: np.ndarray, sides: tuple[int, ...]) -> list[np.ndarray]:
    """Means over the area of each cell of grids of some sides. Rows are taken in stripes, so that only a stripe of the image is held as floats."""
    height, width, channels = pixels.shape
    down, across = [_weights(height, s) for s in sides], [_weights(width, s) for s in sides]
    out = [np.zeros((s, s, channels)) for s in sides]
    stripe = max(1, STRIPE_BYTES // (8 * width * channels))
    for at in range(0, height, stripe):
        part = pixels[at : at + stripe].astype(np.float64)
        for grid, d, a in zip(out, down, across, strict=True):
            grid += np.tensordot(d[:, at : at + stripe], np.matmul(a, part), (1, 0))
    return out


def signatures_of_pixels(rgb: np.ndarray) -> tuple[int, list[int]]:
    """Perceptual hash (signed 64 bits) and 48 mean colours of an image (height, width, 3) of bytes or floats."""
    fine, coarse = _shrunk(rgb, (GREY, COLOUR))
    grey = fine @ np.array([0.299, 0.587, 0.114]) - 128
    low = (_cosines() @ grey @ _cosines().T).reshape(-1)
    ordered = np.sort(low)
    bits = low > (ordered[31] + ordered[32]) / 2
    value = sum(1 << i for i in np.flatnonzero(bits).tolist())
    return value - (1 << 64) if value >> 63 else value, np.rint(coarse).astype(int).reshape(-1).tolist()


def image_signatures(images: DataFrame) -> DataFrame:
    """Rows (path, phash, color_sig) from Spark's image source (columns of its `image` struct, BGR or grey bytes); what can't be decoded gets nulls.

    A row holds an image's raw bytes. Spark closes a batch at
    `spark.sql.execution.arrow.maxBytesPerBatch` (64 MiB), and here images are
    shrunk one after the other, in stripes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, hashes, colours = [], [], []
            # an image at a time, its bytes where Arrow has them
            for origin, height, width, channels, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                value, grid = None, None
                height, width, channels = height.as_py() or 0, width.as_py() or 0, channels.as_py() or 0
                if data.is_valid and height > 0 and width > 0 and channels in (1, 3, 4) and len(data.as_buffer()) == height * width * channels:
                    raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width, channels)
                    value, grid = signatures_of_pixels(raw[:, :, [2, 1, 0]] if channels >= 3 else np.broadcast_to(raw, (height, width, 3)))
                paths.append(origin.as_py())
                hashes.append(value)
                colours.append(grid)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(hashes, pa.int64()), pa.array(colours, pa.list_(pa.int16()))], names=["path", "phash", "color_sig"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "path string, phash long, color_sig array<short>")
