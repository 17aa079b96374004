"""Paths, names and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterloom import schema


#: Blanks and line ends of Unicode, as a character class.
_BLANKS = r"\s\x0b\x85\p{Z}"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """What stands before the last `/`; an absolute path directly below the root has the parent `/`."""
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut < 0, F.lit("")).when(cut == 0, F.lit("/")).otherwise(F.left(path, cut))


def child(folder: Column, name: Column) -> Column:
    """The path of a name in a folder."""
    return F.concat(F.when(folder == "/", "").otherwise(folder), F.lit("/"), name)


def raw_extension(name: Column) -> Column:
    """The ending after the last dot in its own case; none for hidden files and names without a dot."""
    return F.regexp_extract(name, r"^.+\.([^./]+)$", 1)


def extension(name: Column) -> Column:
    return F.lower(raw_extension(name))


def stem(name: Column) -> Column:
    return F.when(raw_extension(name) == "", name).otherwise(F.regexp_replace(name, r"\.[^./]+$", ""))


def path_depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def is_under(path: Column, folder: Column) -> Column:
    """Equal or inside; `/a/b` doesn't hold `/a/bc`."""
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def relative_path(path: Column, root: Column) -> Column:
    """Path below the root, empty for the root itself, null for what is outside."""
    return F.when(path == root, F.lit("")).when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def ancestors(path: Column) -> Column:
    """All folders from the first below `/` down to `path` itself."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def normalize_path(path: Column) -> Column:
    """`.` and `..` resolved, single slashes, none at the end."""
    empty = F.expr("cast(array() as array<string>)")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))
    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    # nearly all paths hold nothing to resolve and needn't be taken apart
    odd = F.contains(path, F.lit("//")) | F.contains(path, F.lit("/.")) | F.startswith(path, F.lit(".")) | F.endswith(path, F.lit("/"))
    return F.when(~odd, path).when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def sanitize_component(text: Column, most: int = 120) -> Column:
    """A file name component: separators become `-`, control signs go, blanks and line ends (of Unicode too) at the ends go, `most` code points at most."""
    bare = F.regexp_replace(F.translate(text, "/:", "--"), r"[\x00-\x1f]", "")
    cleaned = F.regexp_replace(bare, rf"^[{_BLANKS}]+|[{_BLANKS}]+$", "")
    return F.when(cleaned.isin("", ".", ".."), F.lit("_")).otherwise(F.left(cleaned, F.lit(most)))


def camera_label(make: Column, model: Column, unknown: str = schema.UNKNOWN_DEVICE) -> Column:
    both = F.when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))
    return F.when(make.isNotNull() & model.isNotNull(), both).otherwise(F.coalesce(model, make, F.lit(unknown)))


def resolution_label(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit("×"), height.cast("string"))).otherwise(F.lit("—"))


def location_label(latitude: Column, longitude: Column) -> Column:
    return F.when(latitude.isNotNull() & longitude.isNotNull() & ~((latitude == 0) & (longitude == 0)), F.format_string("%.5f, %.5f", latitude, longitude))


def duration_label(seconds: Column) -> Column:
    total = F.round(seconds).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.when((seconds >= 0) & ~F.isnan(seconds) & (seconds < 1e15), text)


def captured_label(captured_at: Column) -> Column:
    return F.date_format(captured_at, "yyyy-MM-dd HH:mm:ss")


def captured_short(captured_at: Column) -> Column:
    return F.date_format(captured_at, "yyyy-MM-dd")


def file_stamp(captured_at: Column) -> Column:
    return F.date_format(captured_at, "yyyyMMdd-HHmmss")


def kind_of(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(*schema.IMAGE_EXTENSIONS), "image").when(ext.isin(*schema.VIDEO_EXTENSIONS), "video").otherwise("other")


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in schema.KIND_LABELS.items() for x in kv])[kind], F.lit(schema.KIND_LABELS["other"]))


def phash_hex(phash: Column) -> Column:
    return F.lpad(F.lower(F.hex(phash)), 16, "0")


def short_hash(content_hash: Column, quick_signature: Column, phash: Column, item_id: Column) -> Column:
    """Eight digits: content hash, else quick signature, else the low half of the perceptual hash, else a digest of the id."""
    low = F.right(phash_hex(phash), F.lit(8))
    return F.coalesce(F.left(content_hash, F.lit(8)), F.left(quick_signature, F.lit(8)), low, F.left(F.sha2(item_id.cast("string"), 256), F.lit(8)))
