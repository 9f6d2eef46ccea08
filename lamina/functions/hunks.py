"""Line ranges against the hunks of a change. hunks: array<struct<old_start, old_count, new_start, new_count>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hunk_touches(hunk: Column, start: Column, end: Column) -> Column:
    """A hunk with new lines touches what it overlaps; a pure deletion touches a range that holds its place."""
    overlap = (hunk["new_start"] <= end) & (hunk["new_start"] + hunk["new_count"] - 1 >= start)
    return F.when(hunk["new_count"] > 0, overlap).otherwise((start <= hunk["new_start"]) & (hunk["new_start"] <= end))


def touched(hunks: Column, start: Column, end: Column) -> Column:
    return F.exists(hunks, lambda h: hunk_touches(h, start, end))


def old_shift(hunks: Column, start: Column) -> Column:
    """Lines that the hunks before start have added. A pure deletion stands after its new_start."""
    before = F.filter(hunks, lambda h: F.when(h["new_count"] > 0, h["new_start"] + h["new_count"] - 1 < start).otherwise(h["new_start"] < start))
    return F.aggregate(before, F.lit(0).cast("bigint"), lambda s, h: s + h["new_count"] - h["old_count"])


def old_range(hunks: Column, start: Column, end: Column) -> Column:
    """The range in the old file as a struct, or null if a hunk touches it."""
    shift = old_shift(hunks, start)
    return F.when(~touched(hunks, start, end), F.struct((start - shift).alias("start"), (end - shift).alias("end")))


def inside_pure_add(hunks: Column, start: Column, end: Column) -> Column:
    return F.exists(hunks, lambda h: (h["old_count"] == 0) & (h["new_count"] > 0) & (h["new_start"] <= start) & (end <= h["new_start"] + h["new_count"] - 1))


def parse_header(line: Column) -> Column:
    """@@ -a[,b] +c[,d] @@ as a struct; an omitted count is 1; null for other lines."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

    def number(group: int, default: int | None = None) -> Column:
        text = F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))
        return (text if default is None else F.coalesce(text, F.lit(str(default)))).cast("bigint")

    made = F.struct(number(1).alias("old_start"), number(2, 1).alias("old_count"), number(3).alias("new_start"), number(4, 1).alias("new_count"))
    return F.when(line.rlike(pattern), made)


def line_of(source: Column, offset: Column) -> Column:
    """Number of the line, from 1, that holds the code point at offset."""
    return F.size(F.split(F.substring(source, F.lit(1), offset), "\n", -1))


def byte_offset(source: Column, offset: Column) -> Column:
    return F.octet_length(F.substring(source, F.lit(1), offset))
