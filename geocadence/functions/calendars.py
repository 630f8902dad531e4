"""Calendars: 365-day years, capped weeks, fractional years, dates in names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days before each month in a year of 365 days.
BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def doy365(ts: Column) -> Column:
    """Day of a 365-day year: 29 February and 1 March share day 60."""
    before = F.element_at(F.array(*map(F.lit, BEFORE_MONTH)), F.month(ts))
    return (before + F.dayofmonth(ts)).cast("int")


def week52(ts: Column) -> Column:
    return F.least(F.ceil(doy365(ts) / 7), F.lit(52)).cast("int")


def period(ts: Column, by: str) -> Column:
    return {"year": F.year, "quarter": F.quarter, "month": F.month, "week": week52, "doy": doy365}[by](ts).cast("int")


PERIODS = {"quarter": 4, "month": 12, "week": 52, "doy": 365}


def year_length(year: Column) -> Column:
    return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))


def fractional_year(ts: Column) -> Column:
    return F.year(ts) + (F.dayofyear(ts) - 1) / year_length(F.year(ts))


def ordinal_day(ts: Column) -> Column:
    """Proleptic ordinal: 1 is 0001-01-01."""
    return F.datediff(ts, F.lit("1970-01-01").cast("date")) + 719163


def from_number(x: Column) -> Column:
    """A date from a number: a whole year up to 9999, or a fractional year."""
    year = F.floor(x).cast("int")
    start = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(start, F.round((x - year) * year_length(year)).cast("int"))


def find_date(text: Column) -> Column:
    """Date in a label or file name: YYYY-MM-DD (or _), YYYYMMDD, YYYYDDD, yrYYYY, YYYY."""
    at = lambda pattern, k=0: F.regexp_extract(text, pattern, k)
    edge, end = r"(?:^|[^0-9])", r"(?:[^0-9]|$)"
    dashed = F.regexp_replace(at(edge + r"(\d{4}[-_]\d{2}[-_]\d{2})" + end, 1), "_", "-")
    full, julian = at(edge + r"(\d{8})" + end, 1), at(edge + r"((?:19|20)\d{5})" + end, 1)
    year = at(edge + r"((?:19|20)\d{2})" + end, 1)
    some = lambda s, value: F.when(s != "", value)
    day = F.try_to_date(F.concat(F.substring(julian, 1, 4), F.lit("-01-01")), "yyyy-MM-dd")
    number = F.substring(julian, 5, 3).cast("int")
    return F.coalesce(
        some(dashed, F.try_to_date(dashed, "yyyy-MM-dd")),
        some(full, F.try_to_date(full, "yyyyMMdd")),
        F.when((julian != "") & number.between(1, 366), F.date_add(day, number - 1)),
        some(year, F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")),
    )
