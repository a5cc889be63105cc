"""Numeric and date functions as columns (MATH-1 to MATH-8, DT-1 to DT-7, MAP-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(days: Column, half_life: float = 180.0) -> Column:
    """MATH-1: halved every half_life days; unknown age counts in full, a future date as today."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0), days) / half_life), F.lit(1.0))


def idf(n: Column, df: Column) -> Column:
    """MATH-2."""
    return F.greatest(F.lit(1.0), F.ln(n / df) + 1)


def specificity(term: Column) -> Column:
    """MATH-3: longer terms say more, up to 16 characters."""
    return 1 + F.least(F.lit(1.0), F.length(term) / 16)


def rating_factor(rating: Column) -> Column:
    """MATH-4."""
    return F.when(rating == "core", 1.5).when(rating == "marginal", 0.5).otherwise(1.0)


def inlink_factor(inlinks: Column) -> Column:
    """MATH-5."""
    return 1 + 0.5 * F.least(F.lit(3), inlinks)


def half_even(x: Column, digits: int) -> Column:
    """MATH-6."""
    return F.rint(x * 10**digits) / 10**digits


def tenth(p: Column) -> Column:
    """MATH-7: index of ten equal bins."""
    return F.least(F.lit(9), F.floor(p * 10).cast("int"))


def share_of_max(x: Column, top: Column) -> Column:
    """MATH-8, AGG-22."""
    return x / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))


def tolerant_date(value: Column) -> Column:
    """DT-1: the first ten characters as a date, null if they aren't one."""
    return F.try_to_date(F.substring(F.trim(value), 1, 10), "yyyy-MM-dd")


def epoch_date(ts: Column) -> Column:
    """DT-4: the date of a chat time stamp ("seconds.sequence")."""
    return F.to_date(F.timestamp_seconds(F.split_part(ts, F.lit("."), F.lit(1)).try_cast("bigint")))


def older_than(ts: Column, now: Column, days: int) -> Column:
    """DT-5."""
    return now >= ts + F.make_dt_interval(F.lit(days))


def short_date(ts: Column) -> Column:
    """DT-6: "Oct 8"."""
    return F.date_format(ts, "MMM d")


def iso_timestamp(value: Column) -> Column:
    """DT-3: an ISO time stamp, with "Z" or an offset or in the session's time zone; null if it isn't one."""
    return F.trim(value).try_cast("timestamp")


def is_sunday(ts: Column) -> Column:
    """DT-7: the weekly report's day."""
    return F.weekday(ts) == 6


def is_weekend(ts: Column) -> Column:
    """DT-7."""
    return F.weekday(ts) >= 5


def get_or(values: Column, key: str | Column, default: float = 0.0) -> Column:
    """MAP-1: a map's value or a default."""
    return F.coalesce(F.try_element_at(values, key if isinstance(key, Column) else F.lit(key)), F.lit(default))


def top_key(values: Column) -> Column:
    """MAP-1, PRJ-10: the key with the largest value, the least of equal ones."""
    ranked = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.get(ranked, 0)["k"]
