"""Dates of mixed precision, as strings like +1977-00-00T00:00:00Z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precisions coarser than a year, by the years they span as a power of ten.
DECADE, CENTURY, MILLENNIUM = 8, 7, 6
_CALENDAR = r"^([+-]?\d+)-(\d\d)-(\d\d)"


def at_precision(c: Column, precision: Column) -> Column:
    """Month and day as 00 where the precision does not cover them."""
    return (
        F.when(precision <= 9, F.regexp_replace(c, r"^([+-]?\d+)-\d\d-\d\d", "$1-00-00"))
        .when(precision == 10, F.regexp_replace(c, r"^([+-]?\d+-\d\d)-\d\d", "$1-00"))
        .otherwise(c)
    )


def part(c: Column, n: int) -> Column:
    """Year, month or day (1, 2, 3) of a time; null if it cannot be read."""
    return F.nullif(F.regexp_extract(c, _CALENDAR, n), F.lit("")).try_cast("int")


def compare_calendar(a: Column, b: Column) -> Column:
    """Status and note of two times of year precision or finer."""
    ya, yb = part(a, 1), part(b, 1)
    ma, mb, da, db = part(a, 2), part(b, 2), part(a, 3), part(b, 3)
    unread = ya.isNull() | yb.isNull()
    return (
        F.when(a == b, "identical")
        .when(unread, F.when(F.substring(a, 1, 4) == F.substring(b, 1, 4), "similar").otherwise("distinct"))
        .when(ya != yb, "distinct")
        .when((ma == 0) | (mb == 0) | (da == 0) | (db == 0), "similar: precision")
        .when(ma != mb, "similar: month")
        .otherwise("similar: day")
    )


def coarse_range(year: Column, precision: Column) -> Column:
    """(first, last) year that a time of that precision covers; centuries run from 1 to 100, and mirror before year 1."""
    size = F.pow(F.lit(10), F.lit(9) - precision).cast("int")
    decade = F.floor(F.abs(year) / 10) * 10
    group = F.ceil(F.abs(year) / size) * size
    first = F.when(precision == DECADE, decade).otherwise(group - size + 1)
    last = F.when(precision == DECADE, decade + 9).otherwise(group)
    ends = F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"))
    before = F.struct((-last).cast("long").alias("first"), (-first).cast("long").alias("last"))
    exact = F.struct(year.cast("long").alias("first"), year.cast("long").alias("last"))
    return F.when(precision >= 9, exact).when(year < 0, before).otherwise(ends)


def compare_coarse(ya: Column, pa: Column, yb: Column, pb: Column) -> Column:
    """Equal span and precision identical, overlapping spans similar, others distinct."""
    a, b = coarse_range(ya, pa), coarse_range(yb, pb)
    same = (a["first"] == b["first"]) & (a["last"] == b["last"]) & (pa == pb)
    overlap = (a["first"] <= b["last"]) & (b["first"] <= a["last"])
    return F.when(same, "identical").when(overlap, "similar").otherwise("distinct")


def modest_gap_penalty(gap: Column) -> Column:
    return F.least(F.lit(0.35), F.lit(0.25) + (gap - 2).cast("double") / F.lit(30.0))


def closest_gap(a: Column, b: Column) -> Column:
    """The least distance in years over two arrays of years; null if either is empty."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))


def timestamp_text(c: Column) -> Column:
    """YYYY-MM-DD hh:mm:ss of a time of fourteen digits or in ISO form; null for others."""
    digits = F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6")
    iso = F.regexp_replace(c, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.\d+)?Z?$", "$1 $2")
    return F.when(c.rlike(r"^\d{14}$"), digits).when(c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?Z?$"), iso)
