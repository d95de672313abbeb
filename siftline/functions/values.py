"""Dates, money, ranges and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "MM/dd/yyyy")
ANNUAL_FLOOR, ANNUAL_CEILING, SPREAD = 10_000, 2_000_000, 10


def parse_time(x: Column) -> Column:
    """ISO, dates, RFC 822 and epoch seconds or milliseconds; null for anything else. Naive times are UTC."""
    number = F.when(x.rlike(r"^\d{9,13}$"), x.cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number))
    bare = F.regexp_replace(x, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(epoch, *[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS])


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(8.64e10)


def within_age(age: Column, most: Column | float) -> Column:
    """An unknown age passes."""
    return age.isNull() | (age <= most)


def overlaps(low: Column, high: Column, least: float, most: float) -> Column:
    """Ranges with open ends meet; a range with no end known does not."""
    return ~(low.isNull() & high.isNull()) & (F.coalesce(high, F.lit(float("inf"))) >= least) & (F.coalesce(low, F.lit(float("-inf"))) <= most)


def meets_floor(low: Column, high: Column, least: float) -> Column:
    """The upper end, else the lower, reaches the floor; unknown does not."""
    return F.coalesce(high, low) >= least


def under_cap(low: Column, most: float) -> Column:
    """The lower end is under the cap; unknown is."""
    return low.isNull() | (low <= most)


def salary_range(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Annual (min, max) in order, or null: currency and period must be known, values plausible, spread limited."""
    factor = F.when(period == "year", 1).when(period == "month", 12).when(period == "week", 52).when(period == "hour", 2080)
    a, b = F.least(low, high) * factor, F.greatest(low, high) * factor
    good = currency.isNotNull() & factor.isNotNull() & (a >= ANNUAL_FLOOR) & (b <= ANNUAL_CEILING) & (b <= SPREAD * a)
    return F.when(good, F.struct(a.alias("min"), b.alias("max")))


def level_of_years(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years < 2, "entry").when(years < 5, "mid").when(years < 8, "senior").when(years < 12, "staff").otherwise("principal")


def score(parts: dict[str, tuple[Column, float, float | None]]) -> Column:
    """Sum of value times weight, each part under its cap if it has one, to one decimal with ties to even."""
    total = F.lit(0.0)
    for value, weight, cap in parts.values():
        one = value.cast("double") * weight
        total = total + F.coalesce(F.least(one, F.lit(cap)) if cap is not None else one, F.lit(0.0))
    return F.bround(total, 1)
