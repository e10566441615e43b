"""Scalar rules as column expressions. A division is null unless both sides are there and the divisor is positive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divided(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b))


def gap_pct(left: Column, right: Column) -> Column:
    """Difference in percent of the larger side; 0 if both are 0."""
    scale = F.greatest(F.abs(left), F.abs(right))
    return F.when(scale == 0, 0.0).otherwise(F.abs(left - right) / scale * 100)


def compare_level(primary: Column, check: Column) -> Column:
    """Difference in percent of the primary; against 0 it is 0 or 100."""
    return F.when(primary == 0, F.when(check == 0, 0.0).otherwise(100.0)).otherwise(F.abs(primary - check) / F.abs(primary) * 100)


def reading_fault(kind: Column, value: Column) -> Column:
    """Why a reading is refused, null if it is not."""
    return (
        F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not a finite number")
        .when((kind == "ratio") & ~value.between(0, 1), "a ratio lies between 0 and 1")
        .when((kind == "level") & ~(value > 0), "a level is positive")
        .when((kind == "flow") & (value < 0), "a flow is not negative")
    )


def total_or_null(values: Column) -> Column:
    """Of a nullable group: 0 if it is empty, null if any value is null."""
    return F.when(F.count("*") == F.count(values), F.coalesce(F.sum(values), F.lit(0.0)))


def strict_total(values: Column) -> Column:
    """null if the group is empty or any value is null."""
    return F.when((F.count("*") == F.count(values)), F.sum(values))


def measured_total(values: Column) -> Column:
    """0 without rows, the sum of what is measured, null if rows are there but none is measured."""
    return F.when(F.count("*") == 0, 0.0).otherwise(F.sum(values))


def origin_of(method: Column, source_type: Column) -> Column:
    return F.when(method == "disclosed", "manual").when(source_type == "chain", "onchain").otherwise("api")


def move_pct(value: Column, in_force: Column) -> Column:
    """Move from the value in force in percent, to four decimals; null from none or from 0."""
    return F.when(in_force != 0, F.round((value - in_force) / in_force * 100, 4))


def input_tenths(uncached: Column, written: Column, read: Column) -> Column:
    """Input tokens weighted by kind (1, 1.25 and 0.1), in tenths, so that sums are exact."""
    return 10 * uncached + 12.5 * written + read


def newest_slot(hour: Column, every: int) -> Column:
    """Beginning of the slot of so many hours that an hour number lies in."""
    return hour - F.pmod(hour, F.lit(every))


def hour_number(ts: Column) -> Column:
    """Hours since 1970 of an instant: no time zone, daylight saving or turn of the year moves it."""
    return F.floor(F.unix_seconds(ts) / 3600)
