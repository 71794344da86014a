"""Date functions; every age or interval takes its reference date explicitly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """The date in the first ten characters; null if there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def day_number(c: Column) -> Column:
    """Days since 1970, the order key of day-range windows."""
    return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")


def age_years(birth: Column, as_of: Column) -> Column:
    return F.datediff(as_of, birth) / 365.25


def age_by_year(birth: Column, as_of: Column) -> Column:
    return F.year(as_of) - F.year(birth)


def season_flags(c: Column) -> dict[str, Column]:
    month = F.month(c)
    return {"month": month, "is_summer": month.between(6, 8).cast("int"), "is_monsoon": month.between(7, 9).cast("int"), "day_of_year": F.dayofyear(c)}


def month_anchor(as_of: Column, back: Column) -> Column:
    """The first day of the month so many months back."""
    return F.add_months(F.trunc(as_of, "month"), -back)


def mid_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(15))


def week_start(c: Column) -> Column:
    """The Monday of a date's week: orders weeks rightly across New Year."""
    return F.trunc(c, "week")


def birth_from_age(age: Column, as_of: Column) -> Column:
    return F.add_months(as_of, -12 * age)


def hl7_time(c: Column) -> Column:
    return F.date_format(c, "yyyyMMddHHmmss")


def duration_days(n: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return n * F.when(u.startswith("day"), 1).when(u.startswith("week"), 7).when(u.startswith("month"), 30).when(u.startswith("year"), 365)


def date_similarity(a: Column, b: Column) -> Column:
    """1 for equal ISO dates, .85 for year and month, .5 for the year, else 0."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    known = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(known & (a == b), 1.0).when(known & (F.substring(a, 1, 7) == F.substring(b, 1, 7)), 0.85).when(known & (F.substring(a, 1, 4) == F.substring(b, 1, 4)), 0.5).otherwise(0.0)
