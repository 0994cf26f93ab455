"""What bulletins say in figures and days, as expressions of built-in functions; a null text says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that bulletins write as words.
NUMBER_WORDS = {
    "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0,
    "half": 0.5, "a half": 0.5, "one half": 0.5, "a quarter": 0.25, "one quarter": 0.25, "a tenth": 0.1, "one tenth": 0.1,
}
#: Days are named by their first letters; a month's day may carry its ending.
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
OPEN_AHEAD = 6

_N = r"(\d+(?:\.\d+)?|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
_SNOW = r"(?:snow|accumulations?)[^.]*?"
_DAY = (
    r"\b(today|this morning|tomorrow|(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b|"
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? ?\d{1,2}(?:st|nd|rd|th)?\b|(?<![\d/])\d{1,2}/\d{1,2}(?![\d/]))"
)
_OTHER_DAY = r"\b(?:tonight|yesterday|overnight|weekend|week|through|thru|until|till)\b|\d\s*-\s*\d"


def flat_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _number(said: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(said.try_cast("double"), F.try_element_at(words, said))


def amounts(text: Column) -> Column:
    """(snow_low, snow_high, ice, wind_chill): inches of snow, the most ice, and the coldest chill that a text names; null where it names none.

    A range of snow goes before an upper bound, and that before one figure; a
    range of ice before one figure.
    """
    return flat_amounts(flat_text(text))


def flat_amounts(flat: Column) -> Column:
    """``amounts`` of a text that ``flat_text`` made; a column of it keeps Spark from flattening a text for each figure.

    A figure's pattern is tried only where its fixed words stand and no figure before it decides.
    """
    snowy = flat.contains(" inch") & (flat.contains("snow") | flat.contains("accumulation"))
    icy, chilly = flat.contains("inch") & flat.contains("ice"), flat.contains("wind chill")

    def first(pattern: str, group: int = 1) -> Column:
        return _number(F.regexp_extract(flat, pattern, group))

    between = rf"{_SNOW}(?:of|between) {_N} (?:to|and|-) {_N} inch"
    ice_between = rf"ice accumulations?[^.]*?(?:of|between) {_N} (?:to|and|-) {_N} (?:of an )?inch"

    def pair(pattern: str) -> Column:
        """The figures of a range in a text: the pattern is searched once, and then in what it found."""
        found = F.array(F.regexp_extract(flat, pattern, 0))
        number = lambda x, group: _number(F.regexp_extract(x, pattern, group))
        return F.get(F.transform(found, lambda x: F.when(x != "", F.struct(F.least(number(x, 1), number(x, 2)).alias("low"), F.greatest(number(x, 1), number(x, 2)).alias("high")))), F.lit(0))

    def snow(found: Column) -> Column:
        up_to = F.array(first(rf"{_SNOW}(?:up to|less than) {_N} inch"))
        one = F.array(first(rf"{_SNOW}(?:of|around|near) {_N} inch"))
        single = F.get(F.transform(one, lambda x: F.struct(x.alias("low"), x.alias("high"))), F.lit(0))
        bounded = F.get(F.transform(up_to, lambda x: F.when(x.isNotNull(), F.struct(F.lit(0.0).alias("low"), x.alias("high")))), F.lit(0))
        return F.coalesce(found, bounded, single)

    ranges = F.when(snowy, snow(pair(between)))
    ice = F.when(icy, F.coalesce(F.when(flat.contains("ice accumulation"), pair(ice_between)["high"]), first(rf"{_N} (?:of an )?inch(?:es)? (?:of )?ice")))
    chills = F.regexp_extract_all(flat, F.lit(r"(wind chills?[^.]*?(?:as low as|to|of|near|around) (?:minus )?\d+ ?(?:below|above)?)"), F.lit(1))

    def degrees(said: Column) -> Column:
        value = F.regexp_extract(said, r"(\d+) ?(?:below|above)?$", 1).try_cast("int")
        return F.when(said.rlike(r"minus \d+|below$"), -value).otherwise(value)

    both = F.transform(F.array(ranges), lambda r: F.struct(r["low"].alias("snow_low"), r["high"].alias("snow_high"), ice.alias("ice"), F.when(chilly, F.array_min(F.transform(chills, degrees))).alias("wind_chill")))
    return F.get(both, F.lit(0))


def open_days(text: Column, posted: Column) -> Column:
    """The days that an open statement names, in order, read against the day it was posted.

    A weekday is its next date from then on, a month's day that date within
    ``OPEN_AHEAD`` days.  Where a word names a day in another way, or a day
    lies out of reach, there are none; so too without a text or a posting day.
    """
    flat = flat_text(text)

    def soon(month: Column, day: Column) -> Column:
        dates = [F.try_to_date(F.concat_ws("-", F.year(F.add_months(posted, months)).cast("string"), month.cast("string"), day), "yyyy-M-d") for months in (0, 12)]
        near = [F.when(F.datediff(d, posted).between(0, OPEN_AHEAD), d) for d in dates]
        return F.coalesce(*near)

    def dated(said: Column) -> Column:
        start = F.substring(said, 1, 3)
        weekday, month = F.array_position(F.array(*map(F.lit, DAYS)), start), F.array_position(F.array(*map(F.lit, MONTHS)), start)
        next_weekday = F.date_add(posted, F.pmod(weekday - 1 - F.weekday(posted), F.lit(7)).cast("int"))
        numbered = said.rlike(r"^[a-z]+\.? ?\d")
        return (
            F.when(said.isin("today", "this morning"), posted)
            .when(said == "tomorrow", F.date_add(posted, 1))
            .when(said.contains("/"), soon(F.split_part(said, F.lit("/"), F.lit(1)), F.split_part(said, F.lit("/"), F.lit(2))))
            .when(numbered, soon(month, F.regexp_extract(said, r"(\d+)", 1)))
            .otherwise(next_weekday)
        )

    days = F.transform(F.regexp_extract_all(flat, F.lit(_DAY), F.lit(1)), dated)
    exact = ~F.regexp_replace(flat, _DAY, " ").rlike(_OTHER_DAY) & F.forall(days, lambda d: d.isNotNull())
    return F.when(F.coalesce(exact, F.lit(False)), F.array_sort(F.array_distinct(days))).otherwise(F.array().cast("array<date>"))
