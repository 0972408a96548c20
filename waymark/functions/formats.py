"""Values as people read them: bytes, lengths, counts, times. Missing values are a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def bytes_text(x: Column) -> Column:
    """Powers of 1024; one digit after the point below ten of a unit."""
    power = F.least(F.floor(F.log(x) / F.log(F.lit(1024.0)) + 1e-12), F.lit(len(UNITS) - 1))
    value = x / F.pow(F.lit(1024.0), power)
    number = F.when((value >= 10) | (power == 0), _fixed(value, 0)).otherwise(_fixed(value, 1))
    return F.when(x.isNull() | F.isnan(x), "\u2014").when(x == 0, "0 B").otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), (power + 1).cast("int"))))


def distance_text(x: Column) -> Column:
    return F.when(x.isNull(), "\u2014").when(x >= 1000, F.concat(_fixed(x / 1000, 1), F.lit(" km"))).otherwise(F.concat(F.floor(x + 0.5).cast("string"), F.lit(" m")))


def count_text(x: Column) -> Column:
    """Groups of three digits; from ten thousand on in units of 10^4 and 10^8, one digit after
    the point below a hundred of them."""
    big = F.when(x >= 100_000_000, 1e8).otherwise(1e4)
    value = x / big
    short = F.regexp_replace(F.when(value >= 100, _fixed(value, 0)).otherwise(_fixed(value, 1)), r"\.0$", "")
    unit = F.when(x >= 100_000_000, "\uc5b5").otherwise("\ub9cc")
    return F.when(x.isNull(), "\u2014").when(x >= 10_000, F.concat(short, unit)).otherwise(F.format_number(x, 0))


def date_text(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "MM. dd. HH:mm"), F.lit("\u2014"))


def clock_text(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "HH:mm:ss"), F.lit("\u2014"))


def duration_text(seconds: Column) -> Column:
    """Seconds rounded up, from a minute on with minutes."""
    up = F.ceil(seconds - F.floor(seconds / 60) * 60).cast("string")
    long_ = F.concat(F.floor(seconds / 60).cast("string"), F.lit("\ubd84 "), up, F.lit("\ucd08"))
    return F.when(seconds.isNull() | (seconds < 0), "\uacc4\uc0b0 \uc911").when(seconds < 60, F.concat(F.ceil(seconds).cast("string"), F.lit("\ucd08"))).otherwise(long_)
