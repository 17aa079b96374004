"""Reading parts of files: tasks open the paths themselves, so a video costs its ends and not its length.

Spark's `binaryFile` reads whole files of 2 GiB at most. Here tasks get paths,
open them with Arrow's file systems (local paths, `file://`, `s3://`, `gs://`,
`hdfs://`) and read what they need: 256 KiB or 512 KiB at both ends, or one
piece of 4 MiB after the other. Only digests and numbers leave a task.

A file that can't be opened or read gives a row with nulls and `error`; a file
that changes its size meanwhile is told by its size. Rows with equal paths are
read once each; a null path is an error too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.functions import capture

#: Bytes of each end for a signature and for the search of a movie header; bytes of a piece.
QUICK_BYTES, PROBE_BYTES, PIECE_BYTES = 256 * 1024, 512 * 1024, 4 * 1024 * 1024
#: What a task should read, as far as whole files allow it.
TASK_BYTES = 1 << 30
#: Where a name of a path's scheme ends.
_SCHEME = "://"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if _SCHEME in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if _SCHEME in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class OpenFile:
    """A file with a size, read by ranges; counts the bytes it has given."""

    def __init__(self, path: str):
        system, inner = place(path)
        self.file = system.open_input_file(inner)
        self.size, self.read = self.file.size(), 0

    def at(self, offset: int, most: int) -> bytes:
        part = self.file.read_at(min(most, max(0, self.size - offset)), offset)
        self.read += len(part)
        return part

    def __enter__(self) -> OpenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def header_seconds(*ends: bytes) -> int | None:
    """Raw seconds of the first movie header with an accepted value: version 0 has 32 bits, version 1 has 64, big-endian."""
    for part in ends:
        at = part.find(b"mvhd")
        while at >= 0:
            wide = part[at + 4 : at + 5] == b"\x01"
            raw = part[at + 8 : at + (16 if wide else 12)]
            if len(raw) == (8 if wide else 4) and capture.MAC_EPOCH <= (value := int.from_bytes(raw, "big")) <= capture.MAC_LATEST:
                return value
            at = part.find(b"mvhd", at + 4)
    return None


def _of_ends(file: OpenFile, probe: bool) -> tuple[int, str, int | None]:
    """Size, quick signature and raw header seconds, each end being read once.

    The signature is the sha256 of the size (64 bits, little endian), the first
    256 KiB, and the last 256 KiB if there are more than 512.
    """
    reach = PROBE_BYTES if probe else QUICK_BYTES
    head = file.at(0, reach)
    # of a file under two reaches the rest is the tail, so no byte is read twice
    rest = file.at(max(len(head), file.size - reach), reach)
    digest = hashlib.sha256(file.size.to_bytes(8, "little"))
    digest.update(head[:QUICK_BYTES])
    if file.size > 2 * QUICK_BYTES:
        digest.update((head + rest)[-QUICK_BYTES:] if len(rest) < QUICK_BYTES else rest[-QUICK_BYTES:])
    seconds = None
    if probe:
        tail = (head + rest)[-PROBE_BYTES:] if file.size < 2 * PROBE_BYTES else rest
        seconds = header_seconds(head, tail if file.size > PROBE_BYTES else b"")
    return file.size, digest.hexdigest(), seconds


def _of_whole(file: OpenFile) -> tuple[str]:
    digest, at = hashlib.sha256(), 0
    while piece := file.at(at, PIECE_BYTES):
        digest.update(piece)
        at += len(piece)
    if at != file.size:
        raise OSError(f"{at} of {file.size} bytes")
    return (digest.hexdigest(),)


def _opened(files: DataFrame, columns: list[tuple[str, str, pa.DataType]], of: Callable[[OpenFile], tuple], parts: int) -> DataFrame:
    names = [n for n, _, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                file, found, error = None, (None,) * len(names), None
                try:
                    if path is None:
                        raise OSError("no path")
                    with OpenFile(path) as file:
                        found = of(file)
                except (OSError, pa.ArrowException) as e:
                    error = str(e)[:500]
                rows.append((path, *found, file.read if file else 0, error))
            kinds = [pa.string(), *[k for _, _, k in columns], pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", *names, "bytes_read", "error"])

    schema = ", ".join(["path string", *[f"{n} {t}" for n, t, _ in columns], "bytes_read long", "error string"])
    # paths are dealt anew, as the listing's partitions say nothing of what reading its files costs
    return files.select("path").repartition(parts).mapInArrow(run, schema)


def _parts(files: DataFrame, bytes_of_file: Column | None) -> int:
    """Tasks for TASK_BYTES each; as many as the session shuffles to where sizes aren't known."""
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if bytes_of_file is None:
        return least
    total = files.agg(F.sum(bytes_of_file.cast("double"))).first()[0] or 0.0
    return max(1, min(100_000, max(least, int(total // TASK_BYTES))))


def signatures(files: DataFrame, probe: bool = False) -> DataFrame:
    """Rows (path, file_size, quick_signature, bytes_read, error) of files (path); with `probe` also header_seconds, the raw time of a movie header.

    At most 512 KiB of a file are read, 1 MiB with `probe`.
    """
    columns = [("file_size", "long", pa.int64()), ("quick_signature", "string", pa.string()), ("header_seconds", "long", pa.int64())]
    size = F.least(F.col("file_size"), F.lit(2 * PROBE_BYTES)) if "file_size" in files.columns else None
    done = _opened(files, columns, lambda f: _of_ends(f, probe), _parts(files, size))
    return done if probe else done.drop("header_seconds")


def hashes(files: DataFrame) -> DataFrame:
    """Rows (path, content_hash, bytes_read, error) of files (path): sha256 of all bytes, read in pieces, whatever their number."""
    return _opened(files, [("content_hash", "string", pa.string())], _of_whole, _parts(files, F.col("file_size") if "file_size" in files.columns else None))


def container_times(videos: DataFrame) -> DataFrame:
    """Rows (path, created_seconds) of files (path): the creation time of the movie header, looked for in both ends of a file."""
    return signatures(videos, probe=True).select("path", capture.mac_epoch_to_seconds(F.col("header_seconds")).alias("created_seconds"))


def confirmed_hashes(items: DataFrame) -> DataFrame:
    """`items` (path, quick_signature) with content_hash only where the signature occurs more than once: no other file is opened."""
    twice = items.filter("quick_signature IS NOT NULL").groupBy(F.col("quick_signature").alias("q")).agg(F.count("*").alias("m")).filter("m > 1")
    asked = items.join(twice, F.col("quick_signature") == F.col("q"), "left_semi").select(*[c for c in ("path", "file_size") if c in items.columns]).dropDuplicates(["path"])
    hashed = hashes(asked).select(F.col("path").alias("_p"), "content_hash")
    return items.drop("content_hash").join(hashed, F.col("path") == F.col("_p"), "left").drop("_p")
