"""Times: clock texts from milliseconds, milliseconds from SRT stamps, frames from seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def milliseconds(seconds: Column) -> Column:
    """Rounded half to even."""
    return F.bround(seconds * 1000, 0).cast("bigint")


def minutes(ms: Column) -> Column:
    """mm:ss.mmm"""
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def hours(ms: Column) -> Column:
    """HH:MM:SS.mmm"""
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def file_stamp(ms: Column) -> Column:
    """HHhMMmSSsmmm, for names of files"""
    return F.format_string("%02dh%02dm%02ds%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_milliseconds(stamp: Column) -> Column:
    """Milliseconds of H:MM:SS,mmm; null where minutes or seconds are 60 or more, or the form differs."""
    part = [F.regexp_extract(stamp, r"^(\d+):(\d{2}):(\d{2})[,.](\d{3})$", i) for i in range(1, 5)]
    h, m, s, ms = [F.when(p != "", p).cast("bigint") for p in part]
    return F.when((m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1000 + ms)


def frame_boundary(seconds: Column, rate_num: Column, rate_den: Column, precision: float = 0.0) -> Column:
    """The first frame at or after a time: a whole number where only noise keeps it from one, else the next.

    Noise is 8 units in the last place, or what a time rounded to the given precision (in seconds) may be off, in frames
    and 1e-4 of a frame at most; so no real part of a frame is taken for it.
    """
    value = seconds * rate_num / rate_den
    near = F.bround(value, 0)
    unit = F.when(value == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - 52))
    tolerance = F.greatest(8 * unit, F.least(F.lit(1e-4), F.lit(precision) * rate_num / rate_den))
    return F.when(F.abs(value - near) <= tolerance, near).otherwise(F.ceil(value)).cast("bigint")
