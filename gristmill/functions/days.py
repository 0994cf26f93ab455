"""Days, clocks and calendars as expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the anonymous computus."""

    def whole(a: Column, b: int) -> Column:
        return F.floor(a / b)

    a, b, c = year % 19, whole(year, 100), year % 100
    h = (19 * a + b - whole(b, 4) - whole(b - whole(b + 8, 25) + 1, 3) + 15) % 30
    rest = (32 + 2 * (b % 4) + 2 * whole(c, 4) - h - c % 4) % 7
    m = whole(a + 11 * h + 22 * rest, 451)
    days = h + rest - 7 * m + 114
    return F.make_date(year.cast("int"), whole(days, 31).cast("int"), (days % 31 + 1).cast("int"))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (0 is Monday) of a month."""
    first = F.make_date(year.cast("int"), F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def likely_break(day: Column) -> Column:
    """Days that many schools take off though they teach: 18 December to 3 January, Monday to Wednesday of Thanksgiving's week, the third Mondays of January and February,
    Columbus Day, the general election, Veterans Day as observed and the Friday before Easter."""
    year, number = F.year(day), F.month(day) * 100 + F.day(day)
    thanks = nth_weekday(year, 11, 3, 4)
    eleventh = F.make_date(year, F.lit(11), F.lit(11))
    observed = F.date_add(eleventh, F.when(F.weekday(eleventh) == 5, -1).when(F.weekday(eleventh) == 6, 1).otherwise(0))
    election = F.date_add(nth_weekday(year, 11, 0, 1), 1)
    moved = [F.date_sub(easter(year), 2), observed, election, nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), nth_weekday(year, 10, 0, 2)]
    fixed = (number >= 1218) | (number <= 103) | ((day >= F.date_sub(thanks, 3)) & (day < thanks))
    for other in moved:
        fixed = fixed | (day == other)
    return fixed


def school_day(day: Column) -> Column:
    """Monday to Friday from 15 August to 15 June."""
    number = F.month(day) * 100 + F.day(day)
    return (F.weekday(day) < 5) & ((number >= 815) | (number <= 615))


def school_year(day: Column) -> Column:
    """The year in which the school year began, on the first of July."""
    return F.year(day) - (F.month(day) < 7).cast("int")


def counted_days(begin: Column, end: Column, issued: Column) -> Column:
    """The local dates an interval counts for: at 06:00 it holds, or it was issued by then and begins before 15:00."""
    days = F.sequence(F.to_date(begin), F.to_date(end))

    def counts(day: Column) -> Column:
        six = day.cast("timestamp_ntz") + F.expr("interval 6 hours")
        three = day.cast("timestamp_ntz") + F.expr("interval 15 hours")
        return ((begin <= six) & (six < end)) | ((issued <= six) & (six < end) & (six < begin) & (begin < three)) | ((issued <= six) & (six < begin) & (begin < three) & (begin < end))

    return F.filter(days, counts)


def local_window(day: Column, zone: Column, start: str, end: str) -> tuple[Column, Column]:
    """A clock window on a local day, as instants of UTC; ``end`` at or before ``start`` is on the next day."""
    later = F.date_add(day, 1) if end <= start else day
    return tuple(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", d.cast("string"), F.lit(t))), zone) for d, t in ((day, start), (later, end)))


def board_date(text: Column) -> Column:
    """A date in one of the forms that boards write; null where none fits."""
    forms = ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in forms])


def following_school_days(first: Column, today: Column, most: int) -> Column:
    """``first`` and the weekdays after it up to today, at most ``most`` days in all."""
    after = F.when(today > first, F.filter(F.sequence(F.date_add(first, 1), today), lambda x: F.weekday(x) < 5)).otherwise(F.array().cast("array<date>"))
    return F.concat(F.array(first), F.slice(after, 1, most - 1))


def night_slot(at: Column) -> Column:
    """The three-hour slot of a moment between 18:00 and 15:00, 0 to 6; null in the afternoon."""
    hours = F.pmod(F.hour(at) - 18, F.lit(24))
    return F.when(hours < 21, F.floor(hours / 3))


def local_day(instant: Column, zone: Column) -> Column:
    """The date that an instant of UTC falls on in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))
