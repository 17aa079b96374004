"""Naming templates. A template is cut on the driver; what runs is one concat of columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterloom import schema

from . import text

#: Folder and rename presets.
FOLDER_PRESETS = ("{yyyy}/{MM}/{MM-dd}/{camera}", "{yyyy}/{MM}/{MM-dd}/{kind}", "{yyyy}/{MM}/{MM-dd}", "{yyyy}/{MM-dd}/{camera}", "{yyyy}/{MM-dd}/{kind}", "{yyyy}/{MM-dd}", "{MM-dd}/{camera}", "{MM-dd}/{kind}", "{MM-dd}")
RENAME_PRESETS = ("", "{datetime}_{orig}", "{orig}_{hash8}", "{datetime}_{camera}_{seq}", "{camera}_{yyyyMMdd}_{seq}", "{yyyyMMdd}_{seq}", "{yyyyMMdd_HHmmss}")
#: Variables that are written as a date pattern.
_DATES = {
    "yyyy": "yyyy", "yy": "yy", "MM": "MM", "dd": "dd", "HH": "HH", "mm": "mm", "ss": "ss",
    "yyyyMMdd": "yyyyMMdd", "HHmmss": "HHmmss", "yyyy-MM-dd": "yyyy-MM-dd", "yyyy-MM": "yyyy-MM", "MM-dd": "MM-dd",
    "yyyyMMdd_HHmmss": "yyyyMMdd_HHmmss", "yyyy-MM-dd_HH-mm-ss": "yyyy-MM-dd_HH-mm-ss", "yyyy年MM月dd日": "yyyy年MM月dd日", "yyyy年MM月": "yyyy年MM月",
    "datetime": "yyyy-MM-dd_HH-mm-ss", "date": "yyyy-MM-dd", "time": "HH-mm-ss",
}


def week_of_year(ts: Column) -> Column:
    """Weeks from Sunday on, the one with 1 January being the first (not ISO)."""
    jan1 = F.trunc(ts, "year")
    days_in_year = F.dayofyear(F.last_day(F.add_months(jan1, 11)))
    first = F.dayofweek(jan1) - 1
    week = F.floor((F.dayofyear(ts) - 1 + first) / 7) + 1
    next_first = F.dayofweek(F.add_months(jan1, 12)) - 1
    return F.when(days_in_year - F.dayofyear(ts) < next_first, F.lit(1)).otherwise(week).cast("int")


def padded(n: Column, width: int) -> Column:
    """Zeros in front, never a digit cut; the width is held in 1 to 12, negative numbers count as 0."""
    width = min(12, max(1, width))
    digits = F.greatest(n, F.lit(0)).cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


@dataclass(frozen=True)
class Fields:
    """The columns that variables are made of."""

    captured_at: Column
    file_name: Column
    kind: Column
    make: Column
    model: Column
    lens: Column
    source_root: Column
    hash8: Column
    seq: Column

    @staticmethod
    def of(columns: list[str], seq: Column) -> Fields:
        """By the catalogue's names; columns that `columns` doesn't list are null."""
        c = lambda name, kind="string": F.col(name) if name in columns else F.lit(None).cast(kind)
        hash8 = text.short_hash(c("content_hash"), c("quick_signature"), c("phash", "long"), F.col("item_id"))
        return Fields(c("captured_at", "timestamp_ntz"), c("file_name"), c("kind"), c("make"), c("model"), c("lens"), c("source_root"), hash8, seq)


def variables(fields: Fields, padding: int = 4, unknown_date: str = schema.UNKNOWN_DATE_FOLDER) -> dict[str, Column]:
    ts = fields.captured_at
    out = {name: F.coalesce(F.date_format(ts, pattern), F.lit(unknown_date)) for name, pattern in _DATES.items()}
    root = text.file_name(fields.source_root)
    return out | {
        "weekNumber": F.coalesce(F.lpad(week_of_year(ts).cast("string"), 2, "0"), F.lit(unknown_date)),
        "camera": text.camera_label(fields.make, fields.model),
        "make": F.coalesce(fields.make, F.lit(schema.UNKNOWN_MAKE)),
        "model": F.coalesce(fields.model, F.lit(schema.UNKNOWN_MODEL)),
        "lens": F.coalesce(fields.lens, F.lit(schema.UNKNOWN_LENS)),
        "kind": text.kind_label(fields.kind),
        "ext": text.extension(fields.file_name),
        "orig": text.stem(fields.file_name),
        "seq": padded(fields.seq, padding),
        "hash8": fields.hash8,
        "sourceFolder": F.when(F.coalesce(root, F.lit("")) == "", F.lit(schema.ROOT_FOLDER)).otherwise(root),
    }


def pieces(template: str) -> list[tuple[bool, str]]:
    """(is a variable, text) from left to right; an unclosed brace is plain text."""
    return [(bool(v), v or plain) for v, plain in re.findall(r"\{([^}]*)\}|((?:[^{]|\{(?![^}]*\}))+)", template)]


def unknown_variables(template: str) -> list[str]:
    known = set(_DATES) | {"weekNumber", "camera", "make", "model", "lens", "kind", "ext", "orig", "seq", "hash8", "sourceFolder"}
    return sorted({v for is_variable, v in pieces(template) if is_variable and v not in known})


def render(template: str, variables: dict[str, Column]) -> Column:
    """One pass; unknown variables stay as written, values aren't expanded again."""
    parts = [variables[p] if v and p in variables else F.lit("{" + p + "}" if v else p) for v, p in pieces(template)]
    return F.concat(*parts) if parts else F.lit("")


def clean_folder(rendered: Column) -> Column:
    """A rendered folder with each of its components cleaned; short ones of plain signs are clean as they are."""
    parts = F.filter(F.split(rendered, "/"), lambda x: x != "")
    cleaned = F.array_join(F.transform(parts, lambda x: text.sanitize_component(x)), "/")
    plain = (F.length(rendered) <= 120) & ~rendered.rlike("[^0-9A-Za-z_/-]|//|^/|/$")
    return F.when(plain, rendered).otherwise(cleaned)


def render_folder(template: str, variables: dict[str, Column]) -> Column:
    return clean_folder(render(template, variables))


def render_file_name(template: str, variables: dict[str, Column]) -> Column:
    return text.sanitize_component(render(template, variables), 180)
