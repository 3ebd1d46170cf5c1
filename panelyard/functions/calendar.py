"""Quarter arithmetic and overlaps of periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(day: Column) -> Column:
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")


def quarter_label(qi: Column) -> Column:
    return F.concat(F.floor(qi / 4).cast("int"), F.lit("Q"), (F.pmod(qi, F.lit(4)) + 1).cast("int"))


def quarter_end(qi: Column) -> Column:
    return F.last_day(F.make_date(F.floor(qi / 4).cast("int"), (F.pmod(qi, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def overlap_year(period_end: Column, start: Column, end: Column) -> Column:
    """The share of the 365 days that end with period_end which lie from start to end."""
    first = F.date_sub(period_end, 364)
    days = F.datediff(F.least(period_end, end), F.greatest(first, start)) + F.lit(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), days / F.lit(365.0)))


def number(c: Column) -> Column:
    """A number that may be NaN for missing: null then."""
    return F.when(~F.isnan(c), c)


def naive_date(stamp: Column) -> Column:
    """The date of a UTC timestamp text, whatever the session's time zone; null for other texts."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(stamp, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ][0-9:.]+(Z|\+00:?00)?$", 1), F.lit("yyyy-MM-dd")))
