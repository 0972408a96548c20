"""Names, sort keys and tolerant parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_name(x: Column) -> Column:
    """Lower case, letters and digits alone; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), F.lit(""))


def canonical_track(x: Column) -> Column:
    """The trailing integer, or null."""
    return F.regexp_extract(x, "([0-9]+)$", 1).try_cast("bigint")


def natural_key(x: Column, width: int = 20) -> Column:
    """Sorts digit runs as numbers: each is padded to `width`, text around it stays."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "\u0001")


def safe_name(x: Column) -> Column:
    """A file name: anything but letters, digits, dot, dash and underscore becomes one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", ""), F.lit("")), F.lit("unnamed"))


def number_list(x: Column) -> Column:
    """`1;2;x` to [1.0, 2.0, null]."""
    return F.transform(F.split(x, "[,;\\s]+"), lambda p: p.try_cast("double"))


def opaque_id(prefix: str, *parts: Column, digits: int = 19) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts joined by `|`."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def image_time(x: Column) -> Column:
    """yyMMdd_HHmmss with up to six fraction digits to a timestamp; null where it doesn't parse."""
    d = F.regexp_extract(x, r"(\d{6})_(\d{6})(\d{0,6})", 1)
    t = F.regexp_extract(x, r"(\d{6})_(\d{6})(\d{0,6})", 2)
    f = F.rpad(F.regexp_extract(x, r"(\d{6})_(\d{6})(\d{0,6})", 3), 6, "0")
    text = F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 2), F.lit("-"), F.substring(d, 5, 2), F.lit(" "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2), F.lit("."), f)
    return F.when(F.length(d) == 6, text.try_cast("timestamp_ntz"))


def gps_time(week: Column, seconds: Column, leap: int = 18) -> Column:
    """GPS week and seconds of week to UTC."""
    micros = F.round((week.cast("double") * 604800 + seconds - leap) * 1e6).cast("bigint")
    return F.timestamp_micros(F.lit(315964800000000) + micros)  # 1980-01-06


def path_job(path: Column, job: Column) -> Column:
    """The job named, else the folder nearest to the file that begins with `job_`, without `.job`."""
    folders = F.slice(F.reverse(F.split(path, "[/\\\\]")), 2, 1 << 20)
    found = F.filter(folders, lambda p: F.lower(p).startswith("job_"))
    return F.coalesce(job, F.regexp_replace(F.try_element_at(found, F.lit(1)), r"\.job$", ""))


def path_track(path: Column, track: Column) -> Column:
    """The track named, else the folder nearest to the file that is `Track` and a number."""
    folders = F.slice(F.reverse(F.split(path, "[/\\\\]")), 2, 1 << 20)
    return F.coalesce(track, F.try_element_at(F.filter(folders, lambda p: p.rlike(r"(?i)^track[_-]?\d+$")), F.lit(1)))


def container_name(x: Column, end: str) -> Column:
    """A job's or scan's name without its ending, in lower case; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(x)), rf"\Q{end}\E$", ""), F.lit(""))
