"""Capture times and camera metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date and time in a file name; seconds between 1904 and 1970; accepted creation times.
NAME_PATTERN = r"(19\d{2}|20\d{2})[-_. ]?(0[1-9]|1[0-2])[-_. ]?(0[1-9]|[12]\d|3[01])(?: at |[-_. ])?([01]\d|2[0-3])[:.]?([0-5]\d)[:.]?([0-5]\d)"
MAC_EPOCH, MAC_LATEST = 2_082_844_800, 6_185_289_600
FIRST_YEAR, LAST_YEAR = 1970, 2100


def make_ts_checked(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """A wall-clock time; null for dates that don't exist and years outside 1970 to 2100. Second 60 counts as 59."""
    made = F.try_make_timestamp_ntz(y, mo, d, h, mi, F.when(s == 60, F.lit(59)).otherwise(s))
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), made)


def sane_year(ts: Column) -> Column:
    return F.when(F.year(ts).between(FIRST_YEAR, LAST_YEAR), ts)


def capture_ts_from_name(name: Column) -> Column:
    part = lambda i: F.regexp_extract(name, NAME_PATTERN, i).try_cast("int")
    return make_ts_checked(*[part(i) for i in range(1, 7)])


def parse_exif_ts(text: Column, end_of_day: bool = False) -> Column:
    """`YYYY?MM?DD?hh?mm?ss` by places, digits only in these, 19 characters at least; separators aren't looked at.

    Hours go up to 23. With `end_of_day` exactly 24:00:00 is a time too, the
    end of its day as in ISO 8601, so the next day's midnight.
    """
    t = F.trim(text)
    part = lambda at, n: F.regexp_extract(F.substring(t, at, n), rf"^(\d{{{n}}})$", 1).try_cast("int")
    y, mo, d, h, mi, s = part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2)
    made = make_ts_checked(y, mo, d, h, mi, s)
    if end_of_day:
        midnight = make_ts_checked(y, mo, d, F.lit(0), F.lit(0), F.lit(0)) + F.expr("INTERVAL 1 DAY")
        made = F.when((h == 24) & (mi == 0) & (s == 0), midnight).otherwise(made)
    return F.when(F.length(t) >= 19, made)


def mac_epoch_to_seconds(raw: Column) -> Column:
    """Seconds since 1904 as seconds since 1970; null outside the accepted range."""
    return F.when(raw.between(MAC_EPOCH, MAC_LATEST), raw - MAC_EPOCH)


def container_wall_clock(seconds: Column, as_local: bool = True, zone: str = "UTC") -> Column:
    """Container times hold local fields marked as UTC (`as_local`), or true UTC that is moved to `zone`."""
    plain = F.to_timestamp_ntz(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))
    return plain if as_local else F.convert_timezone(F.lit("UTC"), F.lit(zone), plain)


def clean_meta(text: Column) -> Column:
    t = F.trim(text)
    return F.when(~t.isin("", "?", "unknown", "Unknown"), t)


def gps_signed(value: Column, ref: Column, negative: str) -> Column:
    """A coordinate with the sign of its hemisphere; `negative` is S or W."""
    return F.when(F.upper(F.trim(F.coalesce(ref, F.lit("")))) == negative, -F.abs(value)).otherwise(value)


def gps(latitude: Column, latitude_ref: Column, longitude: Column, longitude_ref: Column) -> tuple[Column, Column]:
    """Both signed coordinates; null together where they are 0, 0."""
    la, lo = gps_signed(latitude, latitude_ref, "S"), gps_signed(longitude, longitude_ref, "W")
    null_island = (la == 0) & (lo == 0)
    return F.when(~null_island, la), F.when(~null_island, lo)


def safe_int(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) <= float(2**53)), value.cast("double")).try_cast("long")


def safe_pixel(value: Column) -> Column:
    whole = safe_int(value)
    return F.coalesce(F.when(whole.between(1, 1_000_000), whole), F.lit(0)).cast("int")


def resolve_capture_time(kind: Column, name: Column, *, exif_original: Column, exif_digitized: Column, tiff: Column, container: Column, created: Column, modified: Column, end_of_day: bool = False) -> Column:
    """struct(captured_at, time_source): the first sane candidate in the order of the kind; `end_of_day` as in `parse_exif_ts`."""
    one = lambda ts, source: F.when(ts.isNotNull(), F.struct(ts.alias("captured_at"), F.lit(source).alias("time_source")))
    none = F.struct(F.expr("cast(null as timestamp_ntz)").alias("captured_at"), F.lit("none").alias("time_source"))
    rest = [one(capture_ts_from_name(name), "fileName"), one(sane_year(created), "fileSystem"), one(sane_year(modified), "fileSystem"), none]
    image = F.coalesce(*[one(parse_exif_ts(x, end_of_day), "exif") for x in (exif_original, exif_digitized, tiff)], *rest)
    video = F.coalesce(one(sane_year(container), "container"), *rest)
    return F.when(kind == "video", video).otherwise(image)
